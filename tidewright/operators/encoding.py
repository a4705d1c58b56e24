"""Encoding detection and conversion: bytes are counted in Arrow batches; conversion sees them as ISO-8859-1 text, one character a byte."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import constants as C

#: Bytes that detection looks at, and the scores' thresholds; sources that are counted at once.
SAMPLE, TCVN3_LEAST, VNI_LEAST, UTF8_LEAST, TOGETHER = 8192, 0.08, 0.05, 0.99, 64


def _hits(charset: str, low: int = 0x80, high: int = 0xFF) -> np.ndarray:
    """By byte: whether it stands for another character of the charset than itself."""
    hits = [b for b, c in zip(range(0x80, 0x100), C.CHARSETS[charset], strict=True) if ord(c) not in (b, 0xFFFD) and low <= b <= high]
    return np.isin(np.arange(256), hits)


_BYTE = np.arange(256)
#: By what is counted, the bytes that count.
COUNTED = {"high": _BYTE >= 0x80, "tcvn3": _hits("tcvn3", 0x80, 0xDF), "vni": _hits("vni"), "windows-1258": _hits("windows-1258")}
_FACTS = "struct<total: int, " + ", ".join(f"`{k}`: int" for k in COUNTED) + ", units: int, parts: int>"


def _facts(contents: list[bytes]) -> dict[str, np.ndarray]:
    """Of each source: its bytes, those that COUNTED says, the characters that are whole in UTF-8, and these with all bytes that are in none."""
    sizes = np.array([len(c) for c in contents], np.int64)
    data = np.frombuffer(b"".join(c + b"\0\0\0" for c in contents) + b"\0\0\0", np.uint8)  # no character goes over an end
    starts = np.cumsum(sizes + 3) - sizes - 3
    per_source = lambda mask: (lambda s: s[starts + sizes] - s[starts])(np.concatenate([[0], np.cumsum(mask)]))
    tail = (data >= 0x80) & (data < 0xC0)
    then = [np.concatenate([tail[k:], np.zeros(k, bool)]) for k in (1, 2, 3)]
    whole = [data < 0x80, (data >= 0xC2) & (data < 0xE0) & then[0], (data >= 0xE0) & (data < 0xF0) & then[0] & then[1], (data >= 0xF0) & then[0] & then[1] & then[2]]
    units = [per_source(w) for w in whole]
    covered = sum(u * (k + 1) for k, u in enumerate(units))
    return {"total": sizes, **{k: per_source(m[data]) for k, m in COUNTED.items()}, "units": sum(units), "parts": sum(units) + sizes - covered}


def _told(contents: pa.Array) -> pa.Array:
    parts = []
    for i in range(0, len(contents), TOGETHER):
        facts = _facts([c.as_py() or b"" for c in contents[i : i + TOGETHER]])
        parts.append(pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in facts.values()], list(facts), mask=contents[i : i + TOGETHER].is_null()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([(n, pa.int32()) for n in ("total", *COUNTED, "units", "parts")]))


def counted(content: Column) -> Column:
    """_FACTS of the bytes that detection looks at; null of null."""

    @F.arrow_udf(_FACTS)
    def told(contents: pa.Array) -> pa.Array:
        return _told(contents)

    return told(F.substring(content, 1, SAMPLE))


def scores(f: Column) -> dict[str, Column]:
    high, total = f["high"], f["total"]
    return {
        "tcvn3": F.when(high > total * TCVN3_LEAST, 0.8 * f["tcvn3"] / high).otherwise(0.0),
        "vni": F.when(high > total * VNI_LEAST, 0.75 * f["vni"] / high).otherwise(0.0),
        "windows-1258": F.when(total > 0, 0.7 * f["windows-1258"] / total).otherwise(0.0),
        "utf-8": F.when(total > 0, f["units"] / f["parts"]).otherwise(1.0),
    }


def detect(content: Column) -> Column:
    """struct(encoding, confidence, has_bom, needs_conversion); ties go to the first of tcvn3, vni, windows-1258, utf-8."""
    facts = counted(content)
    s = scores(facts)
    best = F.greatest(*s.values())
    named = F.when(s["tcvn3"] == best, "tcvn3").when(s["vni"] == best, "vni").when(s["windows-1258"] == best, "windows-1258").otherwise("utf-8")
    bom = F.substring(content, 1, 3) == F.lit(b"\xef\xbb\xbf")
    plain = facts["high"] == 0
    encoding = F.when(F.length(content) == 0, "us-ascii").when(bom, "utf-8-sig").when(plain, "us-ascii").when(s["utf-8"] >= UTF8_LEAST, "utf-8").otherwise(named)
    confidence = F.when(F.length(content) == 0, 1.0).when(bom | plain, 0.999).when(s["utf-8"] >= UTF8_LEAST, s["utf-8"]).otherwise(best)
    return F.struct(encoding.alias("encoding"), confidence.alias("confidence"), bom.alias("has_bom"), encoding.isin("tcvn3", "vni", "windows-1258").alias("needs_conversion"))


def convert(content: Column, charset: str) -> Column:
    return F.translate(F.decode(content, "ISO-8859-1"), C.HIGH_BYTES, C.CHARSETS[charset])


def normalize(content: Column, encoding: Column) -> Column:
    """UTF-8 text of bytes in a detected encoding; null where there is no conversion."""
    out = F.when(encoding == "utf-8-sig", F.decode(F.substring(content, 4, 1 << 30), "UTF-8")).when(encoding.isin("us-ascii", "utf-8"), F.decode(content, "UTF-8"))
    for charset in C.CHARSETS:
        out = out.when(encoding == charset, convert(content, charset))
    return out


#: Names of encodings, by number.
ENCODINGS = ("utf-8", "utf-8-bom", "tcvn3", "vni", "vps", "viscii", "windows-1258", "iso-8859-1", "ascii", "unknown")


def charset_line(path: Column, content: Column) -> Column:
    """What a look at a file says: path, encoding, confidence and marks."""
    d = detect(content)
    return F.concat(
        path, F.lit(": "), d["encoding"], F.lit(" (confidence="), F.format_number(d["confidence"], 3), F.when(d["has_bom"], ", BOM").otherwise(""), F.when(d["needs_conversion"], ", NEEDS-CONVERSION").otherwise(""), F.lit(")")
    )
