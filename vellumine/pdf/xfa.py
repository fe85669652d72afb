"""XFA forms: packets, fields, values and an HTML rendering with everything escaped."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html import escape

#: Fields that a form may hold, and bytes of XML that are parsed.
MOST_FIELDS, MOST_BYTES = 100_000, 64 << 20


def packets(data: str) -> dict[str, str]:
    """XML of the packets by name, the first of each."""
    found = {}
    for name in ("template", "datasets", "config", "localeSet", "xmpmeta", "form"):
        m = re.search(rf"<(?:\w+:)?{name}\b.*?</(?:\w+:)?{name}\s*>", data, re.S)
        if m is not None:
            found[name] = m[0]
    return found


def parsed(xml: str) -> ET.Element | None:
    """A tree, or None where it isn't well formed, too long, or declares entities."""
    if len(xml) > MOST_BYTES or "<!ENTITY" in xml or "<!DOCTYPE" in xml:
        return None
    names = {m for m in re.findall(r"<(\w+):", xml)} | {m for m in re.findall(r"\s(\w+):\w+=", xml)}
    missing = " ".join(f'xmlns:{n}="urn:{n}"' for n in sorted(names) if f"xmlns:{n}=" not in xml and n != "xml")
    try:
        return ET.fromstring(re.sub(r"^<([\w:]+)", rf"<\1 {missing}", xml, count=1) if missing else xml)
    except ET.ParseError:
        return None


def local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def fields(data: str) -> Iterator[dict]:
    """Fields in document order, depth first: name, path, kind of control, value, caption, choices."""
    root = parsed(packets(data).get("template", ""))
    todo = [(root, "")] if root is not None else []
    n = 0
    while todo:
        e, path = todo.pop()
        kind = local(e)
        name = e.get("name", "")
        own = ".".join(x for x in (path, name) if x) if kind in ("subform", "field", "exclGroup", "area", "draw") else path
        if kind == "field":
            n += 1
            if n > MOST_FIELDS:
                raise ValueError(f"more than {MOST_FIELDS} fields in a form")
            ui = next((local(x) for u in e if local(u) == "ui" for x in u), "textEdit")
            text = lambda part: next(("".join(v.itertext()).strip() for v in e if local(v) == part), None)  # noqa: B023, E731
            yield {"name": name, "path": own, "ui": ui, "value": text("value"), "caption": text("caption"), "items": [("".join(x.itertext())).strip() for i in e if local(i) == "items" for x in i], "access": e.get("access", "open")}
            continue
        todo += [(c, own) for c in reversed(list(e)) if local(c) in ("subform", "subformSet", "field", "exclGroup", "area", "template", "pageSet", "pageArea", "contentArea")]


def value(data: str, name: str) -> str | None:
    """What the data packet holds for a field."""
    m = re.search(rf"<{re.escape(name)}(?:\s[^>]*)?>(.*?)</{re.escape(name)}\s*>", packets(data).get("datasets", ""), re.S)
    return None if m is None else re.sub(r"<[^>]*>", "", m[1])


def with_value(data: str, name: str, new: str) -> str:
    """The form with a field's value in its data packet replaced."""
    own = packets(data).get("datasets")
    if own is None:
        return data
    changed = re.sub(rf"(<{re.escape(name)}(?:\s[^>]*)?>).*?(</{re.escape(name)}\s*>)", lambda m: m[1] + escape(new, quote=False) + m[2], own, count=1, flags=re.S)
    return data.replace(own, changed, 1)


def html(data: str) -> str:
    """A form of HTML controls by the fields' kinds."""
    out = ['<form class="xfa">']
    for f in fields(data):
        name, held = escape(f["path"]), escape(value(data, f["name"]) or f["value"] or "")
        label = f'<label>{escape(f["caption"] or f["name"])}'
        if f["ui"] == "checkButton":
            control = f'<input type="checkbox" name="{name}"{" checked" if held in ("1", "true", "on") else ""}>'
        elif f["ui"] == "choiceList":
            control = f'<select name="{name}">' + "".join(f'<option{" selected" if escape(i) == held else ""}>{escape(i)}</option>' for i in f["items"]) + "</select>"
        elif f["ui"] == "button":
            control = f'<button type="button" name="{name}">{escape(f["caption"] or "")}</button>'
        else:
            kind = {"numericEdit": "number", "dateTimeEdit": "date", "passwordEdit": "password", "signature": "hidden", "imageEdit": "file"}.get(f["ui"], "text")
            control = f'<input type="{kind}" name="{name}" value="{held}">'
        out.append(f"{label} {control}</label>")
    return "\n".join([*out, "</form>"])
