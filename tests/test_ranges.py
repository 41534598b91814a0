"""Files cut into ranges of every size give what a whole read gives."""

import base64
import random
import struct

import pytest

from peakloom.sources import loader, ranges, spectra_xml

FIELDS = "scan_number precursor_mz precursor_charge retention_time sequence mz_array intensity_array spectrum_id".split()


def floats(values, kind):
    return base64.b64encode(struct.pack(f"{kind[0]}{len(values)}{kind[1]}", *values)).decode()


def mzml(n, prefix=""):
    r, out = random.Random(1), []
    for i in range(n):
        level, values = r.choice([1, 2, 2, 3]), [r.random() for _ in range(r.randrange(0, 40))]
        array = lambda kind: f'<{prefix}binaryDataArray><{prefix}cvParam accession="{kind}"/><{prefix}cvParam accession="MS:1000523"/><{prefix}binary>{floats(values, "<d")}</{prefix}binary></{prefix}binaryDataArray>'  # noqa: B023, E731
        body = f'<{prefix}cvParam accession="MS:1000511" value="{level}"/><{prefix}cvParam accession="MS:1000744" value="{i + 0.5}"/>' + array("MS:1000514") + array("MS:1000515")
        out.append(f'<{prefix}spectrum\n index="{i}" id="{"x &gt; y" if i % 2 else f"scan={i}"}" note=\'a > b\'>{body}</{prefix}spectrum>' if i % 7 else f'<{prefix}spectrum id="none"/>')
    space = f' xmlns{":" + prefix[:-1] if prefix else ""}="http://psi.hupo.org/ms/mzml"'
    return f'<?xml version="1.0" encoding="ISO-8859-1"?>\n<{prefix}mzML{space}><{prefix}run><{prefix}spectrumList count="{n}">' + "\n ".join(out) + f"</{prefix}spectrumList></{prefix}run></{prefix}mzML>"


def mzxml(n):
    """Scans of the first level hold those of the second, and these some of the third."""
    r, out, depth = random.Random(2), [], []
    for i in range(n):
        level = 1 if not depth else r.choice([x for x in (1, 2, 3) if x <= depth[-1] + 1])
        while depth and depth[-1] >= level:
            out.append("</scan>\n")
            depth.pop()
        values = [r.random() for _ in range(2 * r.randrange(0, 30))]
        out.append(f'<scan num="{i}" msLevel="{level}" retentionTime="PT{i}.5S"><scanOrigin parentFileID="f" num="{i}"/><precursorMz precursorCharge="2">{i + 0.25}</precursorMz><peaks precision="64">{floats(values, ">d")}</peaks>')
        depth.append(level)
    return "<mzXML><msRun>" + "".join(out) + "</scan>" * len(depth) + "<index><offset/></index></msRun></mzXML>"


@pytest.mark.parametrize(("kind", "text", "read", "parse"), [
    ("mzml", mzml(300), loader.read_mzml, loader.parse_mzml), ("mzml", mzml(100, "m:"), loader.read_mzml, loader.parse_mzml), ("mzxml", mzxml(300), loader.read_mzxml, loader.parse_mzxml),
])
@pytest.mark.parametrize("split", [None, 7919])
def test_like_a_whole_read(spark, tmp_path, kind, text, read, parse, split):
    for name in ("a", "b"):
        (tmp_path / f"{name}.{kind}").write_bytes(text.encode("iso-8859-1"))
    (tmp_path / "_hidden").write_text("x")
    names = [f.split()[0] for f in loader.RAW.split(", ")]
    want = loader._finished(spark.createDataFrame([tuple(f"file:{tmp_path}/{f}.{kind}" if n == "file" else r[n].tolist() if hasattr(r[n], "tolist") else r[n] for n in names) for f in "ab" for r in parse(text.encode("iso-8859-1"))], loader.RAW))
    got = read(spark, str(tmp_path), split=split)
    assert sorted(map(str, got.select(FIELDS).collect())) == sorted(map(str, want.select(FIELDS).collect()))
    if split:
        assert got.rdd.getNumPartitions() == 2 * -(-len(text.encode("iso-8859-1")) // split) > 8


@pytest.mark.parametrize("chunk", [1, 7, 64, 10_000])
def test_elements_of_every_range(monkeypatch, chunk):
    """Each element comes out of one range, wherever ranges and reads end."""
    monkeypatch.setattr(spectra_xml, "CHUNK", chunk)
    text = mzml(12).encode()
    whole = None
    for split in (1 if chunk > 7 else 50, 97, 1000, len(text)):
        found = []
        for start in range(0, len(text), split):
            found += spectra_xml.elements(reads(text, start), start, min(len(text), start + split), "spectrum", False)
        whole = whole or found
        assert found == whole and len(found) == 12 and [spectra_xml.parsed(e).get("index") for e in found] == [str(i) if i % 7 else None for i in range(12)]


def reads(text, start):
    at = start

    def read(n):
        nonlocal at
        out = text[at : at + min(n, spectra_xml.CHUNK)]
        at += len(out)
        return out

    return read


def test_filter_on_level_is_pushed(spark, tmp_path):
    (tmp_path / "a.mzml").write_text(mzml(50))
    rows = loader.read_mzml(spark, f"{tmp_path}/a.mzml")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan peakloom_mzml" in plan and "isnotnull(ms_level" in plan and "= 2" not in plan


def test_broken_files(spark, tmp_path):
    text = mzml(20)
    (tmp_path / "a.mzml").write_text(text[: text.rindex("</spectrum>") - 5])
    with pytest.raises(Exception, match="breaks off in the <spectrum>"):
        loader.read_mzml(spark, f"{tmp_path}/a.mzml").collect()
    with pytest.raises(ValueError, match="no readable input"):
        loader.read_mzml(spark, f"{tmp_path}/none.mzml")


MZML = [
    b'<spectrum id="1"><cvParam accession="MS:1000511" value="2"/></spectrum>',
    b"<p:spectrum id='1'><p:cvParam name='a>b' value = '1' accession='MS:1000511'></p:cvParam><cvParam accession='MS:1000511' value='2'/></p:spectrum>",
    b'<spectrum><cvParam accession="MS:1"/><cvParam xaccession="MS:1000511" accession="MS:2" value="1"/><cvParam myvalue="3" value="2" accession="MS:1000511"/></spectrum>',
]


@pytest.mark.parametrize("raw", MZML)
def test_mzml_level_without_a_parser(raw):
    assert spectra_xml.mzml_level(raw) == spectra_xml.mzml_row(spectra_xml.parsed(raw))["ms_level"]


def test_levels_left_to_the_parser():
    for raw in (b'<spectrum><!-- <cvParam accession="MS:1000511" value="1"/> --></spectrum>', b'<spectrum><cvParam accession="MS:1000511" value="&#50;"/></spectrum>', b"<spectrum/>"):
        assert spectra_xml.mzml_level(raw) is None
    assert spectra_xml.mzxml_level(b'<scan num="1"><peaks msLevel="3"/></scan>') is None
    assert spectra_xml.mzxml_level(b"<scan xmsLevel='1' num='4' msLevel='2'><peaks/></scan>") == 2


def test_counting_needs_no_parser(monkeypatch, tmp_path):
    (tmp_path / "a.mzml").write_bytes(b"<mzML>" + b"".join(MZML) + b"</mzML>")
    monkeypatch.setattr(spectra_xml, "parsed", None)
    files = ranges.packed([(f"file:{tmp_path}/a.mzml", (tmp_path / "a.mzml").stat().st_size)])
    reader = spectra_xml.MzmlSource({"files": files, "level": "2", "counts": "true"}).reader(None)
    assert [b.to_pylist()[0]["n"] for part in reader.partitions() for b in reader.read(part)] == [2]
