"""Tokens, objects, filters and encryption against known values and round trips."""

import base64
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumine.pdf import crypt, filters
from vellumine.pdf.content import CMap, operations
from vellumine.pdf.syntax import END, Name, Parser, Ref, Stream, text_of, written


def one(data):
    return Parser(data).object()


@pytest.mark.parametrize(("data", "value"), [
    (b"42", 42), (b"-17", -17), (b"0", 0), (b"+123", 123), (b"3.14", 3.14), (b"-2.5", -2.5), (b".5", 0.5), (b"10.", 10.0), (b"true", True), (b"false", False), (b"null", None),
    (b"/Name", "Name"), (b"/A#20B", "A B"), (b"(Hello)", b"Hello"), (b"(Hello World)", b"Hello World"), (b"()", b""), (b"(a(b)c)", b"a(b)c"), (b"(\\101\\377\\n)", b"A\xff\n"), (b"<48656C6C6F>", b"Hello"), (b"<>", b""), (b"<4>", b"@"),
    (b"[1 2 3]", [1, 2, 3]), (b"<< /Type /Test /Value 42 >>", {"Type": "Test", "Value": 42}), (b"1 0 R", Ref(1, 0)), (b"% comment\n 7", 7), (b"", END),
])
def test_objects(data, value):
    assert one(data) == value


def test_printing():
    assert [written(v) for v in (42, Name("Test"), True, False, None, Ref(1, 0), 1.5, [1, b"a"])] == ["42", "/Test", "true", "false", "null", "1 0 R", "1.5", "[1 (a)]"]


def test_text():
    assert text_of(b"Hello") == "Hello"
    assert text_of(b"\xfe\xff\0H\0i") == "Hi"
    assert text_of(b"\xef\xbb\xbf\xc3\xa9") == "é"


def test_deep_nesting_is_a_fault():
    with pytest.raises(ValueError):
        one(b"[" * 5000)


@given(st.binary(max_size=600))
@settings(max_examples=60, deadline=None)
def test_filters_round_trip(data):
    assert filters.decode(zlib.compress(data), {"Filter": Name("FlateDecode")}) == data
    assert filters.decode(base64.a85encode(data) + b"~>", {"Filter": Name("A85")}) == data
    assert filters.decode(data.hex().encode() + b">", {"Filter": Name("AHx")}) == data
    twice = base64.a85encode(zlib.compress(data)) + b"~>"
    assert filters.decode(twice, {"Filter": [Name("ASCII85Decode"), Name("Fl")]}) == data


def test_lzw_and_run_length():
    assert filters.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert filters.run_length(b"\x02abc\xfed\x80zzz") == b"abcddd"


def test_predictors():
    up = zlib.compress(b"\x02\x01\x02\x03\x02\x01\x01\x01")
    assert filters.decode(up, {"Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 3}}) == b"\x01\x02\x03\x02\x03\x04"
    sub = zlib.compress(b"\x01\x01\x01\x01")
    assert filters.decode(sub, {"Filter": Name("FlateDecode"), "DecodeParms": {"Predictor": 11, "Columns": 3}}) == b"\x01\x02\x03"


def test_unknown_filter_and_broken_flate():
    with pytest.raises(filters.FilterFault):
        filters.decode(b"x", {"Filter": Name("Odd")})
    whole = zlib.compress(bytes(range(256)) * 40)
    assert filters.flate(whole[: len(whole) - 8])[:256] == bytes(range(256))


def test_aes_and_rc4_vectors():
    block = bytes.fromhex("00112233445566778899aabbccddeeff")
    assert crypt._encrypt_block(block, crypt._keys(bytes(range(16)))).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert crypt._encrypt_block(block, crypt._keys(bytes(range(32)))).hex() == "8ea2b7ca516745bfeafc49904b496089"
    assert crypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    sealed = bytes(16) + crypt.aes_encrypt(b"k" * 16, b"sixteen bytes ok" + b"\x10" * 16, bytes(16))
    assert crypt.aes_decrypt(b"k" * 16, sealed) == b"sixteen bytes ok"


def test_cmap():
    m = CMap(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <D83DDE00> endbfchar 3 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0058> <00590059>] <FFFE> <FFFF> <0030> endbfrange")
    assert m.chars[2, 1] == "😀" and m.chars[2, 0x12] == "C" and m.chars[2, 0x21] == "YY" and m.chars[2, 0xFFFF] == "1"


def test_operations():
    ops = list(operations(b"q 1 0 0 1 5 6 cm /f1 12 Tf [(a) -120 (b)] TJ BI /W 1 /H 1 ID \x00 EI Q"))
    assert [o for o, _ in ops] == ["q", "cm", "Tf", "TJ", "BI", "Q"]
    assert ops[2][1] == ["f1", 12] and ops[3][1] == [[b"a", -120, b"b"]]


def test_stream_with_wrong_length():
    n, g, s = Parser(b"5 0 obj << /Length 99 >> stream\nHello\nendstream endobj").indirect()
    assert (n, g) == (5, 0) and isinstance(s, Stream) and s.raw == b"Hello"
