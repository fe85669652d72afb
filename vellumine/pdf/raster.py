"""Pages as pixels: a white page with its images and filled paths' boxes left out, text not drawn."""

from __future__ import annotations

import math

import numpy as np

from vellumine.pdf import filters
from vellumine.pdf.content import TextReader
from vellumine.pdf.document import Document, Page
from vellumine.pdf.syntax import Stream

#: Pixels that a page may have.
MOST = 64 << 20


def pixel_size(width: float, height: float, dpi: float = 150.0, scale_to: int = 0) -> tuple[int, int]:
    """Pixels of a page: points times dpi over 72, rounded up; or the longer side as given."""
    if scale_to:
        s = scale_to / max(width, height)
        return max(1, math.ceil(width * s - 1e-9)), max(1, math.ceil(height * s - 1e-9))
    return max(1, math.ceil(width * dpi / 72 - 1e-9)), max(1, math.ceil(height * dpi / 72 - 1e-9))


def thumbnail_dpi(size: int) -> int:
    return min(72, max(10, size // 11))


def samples(doc: Document, s: Stream, resources: dict) -> np.ndarray | None:
    """RGB of an image whose filters leave samples of 1 or 8 bits."""
    if filters.IMAGES & set(filters.names_of(s.attrs, doc.resolve)):
        return None
    space, n = doc.color_space(s.attrs.get("ColorSpace"), resources)
    w, h = (int(doc.number(s.attrs.get(k), 0) or 0) for k in ("Width", "Height"))
    mask = doc.resolve(s.attrs.get("ImageMask")) is True
    bpc = 1 if mask else int(doc.number(s.attrs.get("BitsPerComponent"), 8) or 8)
    n = 1 if mask else n
    if bpc not in (1, 8) or not 0 < w * h * n <= MOST:
        return None
    data = np.frombuffer(doc.decoded(s), np.uint8)
    row = (w * n * bpc + 7) // 8
    data = np.resize(np.pad(data, (0, max(0, row * h - len(data)))), (h, row))
    x = (np.unpackbits(data, axis=1)[:, :w * n] * 255 if bpc == 1 else data[:, :w * n]).reshape(h, w, n)
    if space == "index":
        own = doc.resolve(s.attrs.get("ColorSpace"))
        table = doc.resolve(own[3]) if isinstance(own, list) and len(own) > 3 else b""
        table = doc.decoded(table) if isinstance(table, Stream) else table if isinstance(table, bytes) else b""
        _, k = doc.color_space(own[1], resources) if isinstance(own, list) and len(own) > 1 else ("rgb", 3)
        colors = np.frombuffer(table[:len(table) // k * k], np.uint8).reshape(-1, k)
        if not len(colors):
            return None
        x = colors[np.minimum(x[:, :, 0] // (255 if bpc == 1 else 1), len(colors) - 1)]
        n = k
    if n == 4:
        c = x.astype(int)
        return (255 - np.minimum(255, c[:, :, :3] + c[:, :, 3:])).astype(np.uint8)
    return np.repeat(x[:, :, :1], 3, axis=2) if n < 3 else x[:, :, :3]


def render(doc: Document, page: Page, dpi: float = 150.0, scale_to: int = 0) -> np.ndarray:
    """RGB pixels: images at their places by nearest samples."""
    a, b, c, d = page.boxes()["crop"]
    w, h = pixel_size(c - a, d - b, dpi, scale_to)
    if w * h > MOST:
        raise ValueError("a page has too many pixels")
    out = np.full((h, w, 3), 255, np.uint8)
    sx, sy = w / (c - a), h / (d - b)
    reader = TextReader(doc, page)
    reader.run()
    own = doc.resolve(page.resources().get("XObject"))
    for i in reader.images:
        s = doc.resolve(own.get(i["name"])) if isinstance(own, dict) else None
        pixels = samples(doc, s, page.resources()) if isinstance(s, Stream) else None
        m = i["matrix"]
        det = m[0] * m[3] - m[1] * m[2]
        if pixels is None or abs(det) < 1e-9:
            continue
        xs = [m[4] + p * m[0] + q * m[2] for p in (0, 1) for q in (0, 1)]
        ys = [m[5] + p * m[1] + q * m[3] for p in (0, 1) for q in (0, 1)]
        x0, x1 = max(0, int((min(xs) - a) * sx)), min(w, math.ceil((max(xs) - a) * sx))
        y0, y1 = max(0, int((d - max(ys)) * sy)), min(h, math.ceil((d - min(ys)) * sy))
        if x0 >= x1 or y0 >= y1:
            continue
        px, py = np.meshgrid((np.arange(x0, x1) + 0.5) / sx + a - m[4], d - (np.arange(y0, y1) + 0.5) / sy - m[5])
        u, v = (px * m[3] - py * m[2]) / det, (py * m[0] - px * m[1]) / det
        inside = (u >= 0) & (u < 1) & (v >= 0) & (v < 1)
        part = out[y0:y1, x0:x1]
        part[inside] = pixels[np.clip(((1 - v) * pixels.shape[0]).astype(int), 0, pixels.shape[0] - 1), np.clip((u * pixels.shape[1]).astype(int), 0, pixels.shape[1] - 1)][inside]
    turns = page.rotate() // 90
    return np.rot90(out, -turns) if turns else out


def jpeg2000_header(data: bytes) -> dict | None:
    """Width, height and components of a JPEG 2000 image: of its codestream's SIZ marker."""
    at = data.find(b"\xff\x4f\xff\x51")
    if at < 0 or len(data) < at + 42:
        return None
    word = lambda k: int.from_bytes(data[at + k:at + k + 4], "big")
    return {"width": word(8) - word(16), "height": word(12) - word(20), "components": int.from_bytes(data[at + 40:at + 42], "big")}
