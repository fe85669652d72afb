"""Media archives and chat logs: exact round trips, retries, odd rows; the pipeline's stages."""

import hashlib
import random
import shutil
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from vellumine.llm import chat, decontaminate, media, queries, secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@given(st.text(max_size=500))
@settings(max_examples=60, deadline=None)
def test_images_round_trip(text):
    payload, n = media.padded(text)
    assert len(payload) % 192 == 0 and payload and payload[:n].decode("utf-8", "surrogatepass") == text and not payload[n:].strip(b" ")
    assert media.samples(media.png(payload)) == payload


def image_by_hand(payload):
    """The image of a payload, written out apart from the operator: grey, 192 samples a row."""
    def chunk(kind, data):
        return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")

    head = (192).to_bytes(4, "big") + (len(payload) // 192).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    rows = b"".join(b"\0" + payload[i:i + 192] for i in range(0, len(payload), 192))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def test_media_of_all_documents(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = media.op5(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        raw = (docs[r["doc_id"]] or "").encode()
        payload = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        image = image_by_hand(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        mean = sum(payload) / len(payload)
        size, told, _, levels = r["feature"].split(" ")
        assert size == f"{len(payload) // 192}x192" and abs(float(told.removeprefix("mean=")) - mean) < 1e-5 and levels == f"levels={len(set(payload))}"


def test_media_odd_rows_and_small_ranges(spark, tmp_path):
    rows = [(1, None), (1, ""), (None, "x" * 192), (3, "é" * 100_000), (3, "é" * 100_000), (-5, "y" * 193)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    where = str(tmp_path / "a")
    media.write_archives(df, where, most=500)
    whole = sorted((d is None, d or 0, len((t or "").encode()), len(media.padded(t)[0])) for d, t in rows)
    spark.dataSource.register(media.MediaSource)
    read = lambda: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], len(r["payload"])) for r in spark.read.format("vellumine_media").option("path", where).option("rangebytes", 300).load().collect())
    assert read() == whole
    shutil.rmtree(f"{where}/{media.MANIFEST}")
    assert read() == whole  # planned from the archives alone
    media.write_archives(df.limit(0), str(tmp_path / "b"))
    assert media.read_archives(spark, str(tmp_path / "b")).count() == 0


def test_ranges_hold_about_equal_bytes_and_are_few(spark, tmp_path, monkeypatch):
    where = str(tmp_path / "d")
    rng = random.Random(1)
    rows = [(k, "".join(rng.choice("abcdefgh") for _ in range(5000 if k % 10 == 0 else 50))) for k in range(200)]
    media.write_archives(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), where, ranged=4000)
    reader = media.ArchiveReader({"path": where, "rangebytes": "4000"})
    planned = [r for p in reader.partitions() for r in p.ranges]
    assert [a[3] for a in planned[:-1]] == [b[2] for b in planned[1:]] and planned[0][2] == 0 and planned[-1][3] == 200
    shutil.rmtree(f"{where}/{media.MANIFEST}")
    again = [r for p in reader.partitions() for r in p.ranges]
    assert again[0][2] == 0 and again[-1][3] == 200 and abs(len(again) - len(planned)) <= 2
    monkeypatch.setattr(media, "PARTITIONS", 3)
    assert len(reader.partitions()) <= 4


def test_a_broken_member_fails_alone_and_is_retried(spark, tmp_path):
    where = tmp_path / "c"
    media.write_archives(spark.createDataFrame([(k, f"text {k} " * 50) for k in range(5)], "doc_id long, text string").coalesce(1), str(where))
    (path,) = where.glob("*.zip")
    data = bytearray(path.read_bytes())
    at = data.index(b"IDAT", data.index(b"IDAT") + 4) + 10
    data[at] ^= 0xFF
    path.write_bytes(data)
    got = media.read_archives(spark, str(where)).collect()
    assert len(got) == 5
    (bad,) = [r for r in got if r["error"] is not None]
    assert bad["attempts"] == media.TRIES and bad["payload"] is None and all(r["attempts"] == 1 for r in got if r["error"] is None)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|end|>", "\\"]), st.lists(st.sampled_from([*"ab\\<|>/\n[]é", "<|end|>", "<|turn|>"]), max_size=20).map("".join)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_templates_round_trip(messages):
    f = chat.render(messages)
    assert chat.parse(f) == messages
    assert [chat.unescape(f[s:e]) for s, e in chat.loss_spans(f)] == [t for r, t in messages if r == "assistant"]


def test_folding_edits_and_regenerations(spark):
    log = [(1, 1, "open", "0", "user", "hi"), (1, 2, "open", "1", "assistant", ""), (1, 3, "delta", "1", "assistant", "wr"), (1, 4, "delta", "1", "assistant", "ong"), (1, 5, "regenerate", "1", "assistant", None), (1, 6, "delta", "1", "assistant", "right"), (1, 7, "edit", "0", "user", "hello"), (2, 1, "open", "0", None, None)]
    df = spark.createDataFrame(log, "conv long, seq long, kind string, slot string, role string, text string").repartition(3)
    got = {r["conv"]: chat.parse(r["formatted"]) for r in chat.reconstruct(df).collect()}
    assert got == {1: [("user", "hello"), ("assistant", "right")], 2: [("", "")]}
    assert chat.reconstruct(df.limit(0)).count() == 0


def test_chat_query_against_the_table(spark, sf):
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    said = "</s>[INST] ok [/INST]"
    turns[-7] = [("user", said), ("assistant", said)]
    got = {r["conv_id"]: r for r in chat.op6(spark, sf).collect()}
    assert set(got) == set(turns)
    for c, t in turns.items():
        loss = "".join(x for r, x in t if r == "assistant")
        assert got[c]["n_turns"] == len(t) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"], got[c]["formatted_chars"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.render(t)))


def test_turns_that_repeat_and_nulls(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 2, "assistant", "y" * 700), (1, 10, "assistant", "z"), (1, 9, "user", "w"), (1, -1, "user", "below")]
    got = {r["conv"]: chat.parse(r["formatted"]) for r in chat.reconstruct(chat.turn_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got == {1: [("", "x"), ("user", "below"), ("user", ""), ("user", ""), ("user", "w"), ("assistant", "z")], None: [("assistant", "y" * 700)]}
    kinds = {r["kind"] for r in chat.turn_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("kind").distinct().collect()}
    assert kinds == {"open", "edit", "regenerate", "delta"}


def odd(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "fine words here token=abcdefgh99 end", "en", "a", 36), (4, "word " * 30_000, "en", "b", 150_000), (5, "same text as another one is", "en", None, 27), (6, "same text as another one is", "en", "b", 27), (6, "same text as another one is", "en", "b", 27), (None, "no id here at all", None, None, 17)]
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("kept")).withColumn("copies", F.lit(7))


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_rows(spark, sf, k):
    _, stage = corpus_pipeline.STAGES[k]
    docs = odd(spark)
    got = stage(spark, docs, sf)
    if k < len(corpus_pipeline.STAGES) - 1:
        assert got.columns == docs.columns and got.where("score <> 'kept'").count() == 0
    got.collect()
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_near_copies_stage(spark, sf):
    got = corpus_pipeline.drop_near_copies(spark, odd(spark), sf).select("doc_id").collect()
    assert sorted((r[0] is None, r[0] or 0) for r in got) == [(False, 1), (False, 2), (False, 3), (False, 4), (False, 5), (True, 0)]


def test_near_copies_are_judged_by_row(spark, sf):
    rows = [(5, "one text of a number five of ours"), (5, "quite another text of the same number"), (3, "a passage that is there twice over here"), (7, "a passage that is there twice over here"), (7, "red green blue and some more colours"), (None, "no number but a copy all the same"), (None, "no number but a copy all the same"), (None, "no number and no copy either of these"), (None, None), (None, None)]
    df = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], DOCS)
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.drop_near_copies(spark, df, sf).collect())
    want = [r for r in rows if r != (7, rows[3][1])]
    want.remove(rows[5])
    assert got == sorted((d or 0, t or "") for d, t in want)


def shingles(text, k=5):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ")
    w = [x for x in w if x]
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def survivors_by_hand(rows):
    """Ids of the rows that stay of near copies, every pair looked at."""
    held = [(d, shingles(t)) for d, t in rows]
    by = {}
    for i, (_, s) in enumerate(held):
        for g in s:
            by.setdefault(g, []).append(i)
    root = list(range(len(held)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, s) in enumerate(held):
        for j in {j for g in s for j in by[g] if j < i}:
            if 10 * len(s & held[j][1]) >= 8 * len(s | held[j][1]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(held):
        least[find(i)] = min(least.get(find(i), d), d)
    return set(least.values())


def test_pipeline_against_its_parts(spark, sf):
    """Stage by stage: what goes, goes for its reason, and clean documents stay."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "mixing sources to target weights"]
    near = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert {r["doc_id"] for r in near.collect()} == survivors_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])
    items = [decontaminate.normal(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = corpus_pipeline.drop_leaks(spark, near, sf).collect()
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in near.collect() if not any(i in decontaminate.normal(r["text"]) for i in items)}
    redacted = corpus_pipeline.redact_secrets(spark, near, sf).collect()
    assert len(redacted) == near.count() and not any(secrets.base_spans(r["text"]) for r in redacted if "SECRET" not in r["text"]) and all(r["n_chars"] == len(r["text"]) for r in redacted)


def test_all_queries_are_named():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n.split("_")[0][2:]))] == [f"op{k}" for k in range(1, 11)]
