"""mzML and mzXML as data sources that cut files between spectra, so that a large file is read by many tasks.

A range of a file holds the spectra whose start tags begin in it; a task finds them by
their tags, parses one at a time and reads on behind the range's end to finish the
last. Rows of other MS levels than the one a filter asks for are not decoded.
"""

from __future__ import annotations

import base64
import itertools
import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from xml.etree import ElementTree
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from peakloom.sources import ranges

RAW = "file string, block long, ordinal long, ms_level int, label string, sequence string, precursor_mz double, precursor_charge long, retention_time double, mz_array array<double>, intensity_array array<double>"
COUNTS = "file string, block long, n long"

# Accessions of the mzML vocabulary.
MS_LEVEL, CHARGE, SCAN_START, MZ_ARRAY, INTENSITY_ARRAY = "MS:1000511", "MS:1000041", "MS:1000016", "MS:1000514", "MS:1000515"
PRECURSOR_MZ = ("MS:1000040", "MS:1000827", "MS:1000744")
PEPTIDE, ZLIB, FLOAT32, FLOAT64 = "MS:1000889", "MS:1000574", "MS:1000521", "MS:1000523"
#: Parsed spectra that are held at once, and bytes that are read at once.
SPECTRA, CHUNK = 1024, 1 << 20

_ATTRIBUTES = rb"""(?:\s+[\w.:-]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*(/?)>"""
_ATTRIBUTE = rb"""(?:\s+[\w.:-]+\s*=\s*(?:"[^"]*"|'[^']*'))*?\s+%s\s*=\s*(?:"([^"]*)"|'([^']*)')"""
_PARAM = re.compile(rb"""<(?:[\w.-]+:)?cvParam(?=((?:\s+[\w.:-]+\s*=\s*(?:"[^"]*"|'[^']*'))*))""" + _ATTRIBUTE % b"accession")
_SCAN = re.compile(rb"""<(?:[\w.-]+:)?scan((?:\s+[\w.:-]+\s*=\s*(?:"[^"]*"|'[^']*'))*)""")
_VALUE, _LEVEL = re.compile(rb"^" + _ATTRIBUTE % b"value"), re.compile(rb"^" + _ATTRIBUTE % b"msLevel")


@lru_cache(maxsize=4096)
def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].rsplit(":", 1)[-1]


def _tag(node: ElementTree.Element) -> str:
    """An element's name without its name space, whether that was resolved or is still a prefix."""
    return _local(node.tag)


_KINDS = {(order, double): np.dtype(f"{order}f{8 if double else 4}") for order in "<>" for double in (False, True)}


def _floats(text: str, double: bool, packed: bool, order: str = "<") -> np.ndarray:
    raw = base64.b64decode(text or "")
    raw = zlib.decompress(raw) if packed and raw else raw
    return np.frombuffer(raw, _KINDS[order, double]).astype(float, copy=False)


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def mzml_row(node: ElementTree.Element, wanted: int | None = None, arrays: bool = True) -> dict | None:
    """A spectrum of mzML; None if it is of another level than the wanted one. A missing precursor m/z or charge is 0."""
    params: dict = {}
    data = []
    for sub in node.iter():
        name = _local(sub.tag)
        if name == "cvParam":
            params.setdefault(sub.get("accession"), sub.get("value"))
        elif name == "binaryDataArray":
            data.append(sub)
    level = _number(params.get(MS_LEVEL))
    if wanted is not None and level != wanted:
        return None
    values = {}
    for array in data if arrays else []:
        kinds, texts = set(), []
        for c in array:
            name = _local(c.tag)
            if name == "cvParam":
                kinds.add(c.get("accession"))
            elif name == "binary":
                texts.append(c.text)
        for kind in (MZ_ARRAY, INTENSITY_ARRAY):
            if kind in kinds:
                values[kind] = _floats(texts[0] if texts else "", FLOAT64 in kinds, ZLIB in kinds)
    mz = next((float(params[a]) for a in PRECURSOR_MZ if params.get(a)), 0.0)
    time = params.get(SCAN_START)
    return {
        "ms_level": level, "label": node.get("id"), "sequence": params.get(PEPTIDE) or "", "precursor_mz": mz, "precursor_charge": _number(params.get(CHARGE)) or 0,
        "retention_time": float(time) if time else None, "mz_array": values.get(MZ_ARRAY, np.zeros(0)), "intensity_array": values.get(INTENSITY_ARRAY, np.zeros(0)),
    }


def mzxml_row(node: ElementTree.Element, wanted: int | None = None, arrays: bool = True) -> dict | None:
    """A scan of mzXML, whose peaks are interleaved pairs in network order; None if it is of another level. A missing precursor m/z or charge is 0."""
    level = _number(node.get("msLevel"))
    if wanted is not None and level != wanted:
        return None
    parts = {_tag(c): c for c in node}
    first, peaks, values = parts.get("precursorMz"), parts.get("peaks"), np.zeros(0)
    if peaks is not None and arrays:
        values = _floats(peaks.text, peaks.get("precision") == "64", peaks.get("compressionType") == "zlib", ">")
    time = node.get("retentionTime")
    peptide = next((c.get("value") or c.text for c in node.iter() if _tag(c) == "peptide"), None) or node.get("peptide") or ""
    return {
        "ms_level": level, "label": node.get("num"), "sequence": peptide, "precursor_mz": float(first.text) if first is not None and first.text else 0.0,
        "precursor_charge": _number(first.get("precursorCharge")) or 0 if first is not None else 0,
        "retention_time": float(time.strip("PTS")) if time else None, "mz_array": values[0::2], "intensity_array": values[1::2],
    }


def mzml_level(raw: bytes) -> int | None:
    """The MS level that mzml_row() finds, from the tags alone; None where it takes a parser to tell."""
    if b"<!" in raw or b"<?" in raw or b"&" in raw:
        return None
    for m in _PARAM.finditer(raw):
        if (m[2] or m[3]) == MS_LEVEL.encode():
            value = _VALUE.search(m[1])
            text = value and (value[1] or value[2])
            return int(text) if text and text.isdigit() else None
    return None


def mzxml_level(raw: bytes) -> int | None:
    """The MS level that mzxml_row() finds, from the start tag alone; None where it takes a parser to tell."""
    opening = _SCAN.match(raw)
    found = opening and _LEVEL.search(opening[1])
    text = found and (found[1] or found[2])
    return int(text) if text and text.isdigit() else None


def parsed(raw: bytes, encoding: str | None = None) -> ElementTree.Element:
    """An element that was cut out of its document: prefixes stay as they are, since their declarations are elsewhere."""
    parser, tree = expat.ParserCreate(encoding), ElementTree.TreeBuilder()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = tree.start, tree.end, tree.data
    parser.Parse(raw, True)
    return tree.close()


def elements(read: Callable[[int], bytes], start: int, end: int, tag: str, nested: bool) -> Iterator[bytes]:
    """The elements of a name whose start tags begin in [start, end) of a file, as bytes; read gives the bytes from start on.

    An element of a nested kind ends where its first child of the same kind begins. Tags inside comments count.
    """
    name = rb"<(/?)((?:[\w.-]+:)?%s)(?=[\s/>])" % tag.encode()
    either, whole = re.compile(name), re.compile(name + _ATTRIBUTES)
    held, at, begin, done = b"", start, 0, False

    def more() -> bool:
        nonlocal held, at, begin, done
        held, at, begin = held[begin:], at + begin, 0
        new = read(max(CHUNK, len(held)))
        held, done = held + new, not new
        return not done

    def found(pattern: re.Pattern, place: int) -> re.Match | None:
        """The next match behind begin + place, reading on as far as it takes."""
        while (m := pattern.search(held, begin + place)) is None or m.end() == len(held):
            if m is not None and done:
                return m
            place = max(place, len(held) - begin - 4096)
            if not more():
                return pattern.search(held, begin + place)
        return m

    while at + begin < end:
        m = either.search(held, begin)
        if m is None or m.end() > len(held) - 1 and not done:
            begin = max(begin, m.start() if m else len(held) - 4096)
            if at + begin >= end or not more():
                if m is None:
                    return
            continue
        if at + m.start() >= end:
            return
        begin = m.start()
        if m[1]:
            begin = m.end()
            continue
        opening = whole.match(held, begin)
        while opening is None and more():
            opening = whole.match(held, begin)
        if opening is None:
            raise ValueError(f"a <{tag}> is damaged at {at + begin}")
        if opening[3]:
            yield opening[0]
            begin = opening.end()
            continue
        size = opening.end() - begin
        closing = found(either, size)
        while closing is not None and not closing[1] and not nested:
            closing = found(either, closing.end() - begin)
        if closing is None:
            raise ValueError(f"the file breaks off in the <{tag}> at {at + begin}")
        yield held[begin : closing.start()] + b"</" + opening[2] + b">"
        begin = closing.start() if not closing[1] else closing.end()


class Range(InputPartition):
    def __init__(self, uri: str, start: int, end: int) -> None:
        self.uri, self.start, self.end = uri, start, end


class SpectraReader(DataSourceReader):
    def __init__(self, options, tag: str, nested: bool, row: Callable, level_of: Callable[[bytes], int | None]) -> None:
        self.level_of = level_of
        self.files, self.split = options["files"], int(options.get("split", ranges.SPLIT))
        self.tag, self.nested, self.row, self.level, self.counting = tag, nested, row, None, options.get("counts") == "true"
        if "level" in options:
            self.level = int(options["level"])

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """An MS level is asked for in the reader; other filters are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ms_level",) and self.level is None:
                self.level = int(f.value)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [Range(*r) for r in ranges.ranges(self.files, self.split)] or [Range("", 0, 0)]

    def rows(self, part: Range) -> Iterator[dict]:
        with ranges.opened(part.uri) as file:
            found = re.search(rb"""<\?xml[^>]*encoding\s*=\s*["']([\w.-]+)["']""", file.read(256))
            encoding = found[1].decode() if found else None
            if encoding and encoding.lower().startswith("utf-16"):
                raise ValueError(f"{part.uri} is not in a byte-wise encoding")
            file.seek(part.start)
            for raw in elements(file.read, part.start, part.end, self.tag, self.nested):
                level = self.level_of(raw) if self.counting and self.level is not None else None
                if level is not None:
                    if level == self.level:
                        yield {}
                elif (row := self.row(parsed(raw, encoding), self.level, not self.counting)) is not None:
                    yield row

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.uri:
            return
        if self.counting:
            n = sum(1 for _ in self.rows(part))
            yield pa.RecordBatch.from_pydict({"file": [part.uri], "block": [part.start], "n": [n]})
            return
        names = [f.split()[0] for f in RAW.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        place = itertools.count()
        for found in itertools.batched(self.rows(part), SPECTRA):
            rows = [{"file": part.uri, "block": part.start, "ordinal": next(place)} | r for r in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)


class SpectraSource(DataSource):
    """Options: files (ranges.packed), split (bytes), level (of MS), counts (true: the number of spectra of each range instead)."""

    def schema(self) -> str:
        return COUNTS if self.options.get("counts") == "true" else RAW


class MzmlSource(SpectraSource):
    @classmethod
    def name(cls) -> str:
        return "peakloom_mzml"

    def reader(self, schema) -> DataSourceReader:
        return SpectraReader(self.options, "spectrum", False, mzml_row, mzml_level)


class MzxmlSource(SpectraSource):
    @classmethod
    def name(cls) -> str:
        return "peakloom_mzxml"

    def reader(self, schema) -> DataSourceReader:
        return SpectraReader(self.options, "scan", True, mzxml_row, mzxml_level)
