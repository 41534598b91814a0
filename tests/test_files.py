"""Readers on files written here."""

import base64
import struct
import zlib

import pytest

from peakloom.sources import loader, sinks

MGF = """BEGIN IONS
TITLE=one
PEPMASS=505.5 1000
CHARGE=2+
SCANS=F1:7
RTINSECONDS=100.0
SEQ=FHHTIGGSR
10.0 1.0
20.0 1.5
END IONS

BEGIN IONS
PEPMASS=300.25
CHARGE=3+
10 1e2
END IONS
BEGIN IONS
PEPMASS=200
CHARGE=2+
END IONS
"""


def test_mgf(tmp_path, spark):
    (tmp_path / "example.mgf").write_text(MGF)
    rows = sorted(loader.load_spectra(spark, f"{tmp_path}/example.mgf").collect(), key=lambda r: r["scan_number"])
    assert [r["spectrum_id"] for r in rows] == ["example:0", "example:1", "example:2"]
    assert rows[0]["mz_array"] == [10.0, 20.0] and rows[0]["intensity_array"] == [1.0, 1.5] and rows[0]["sequence"] == "FHHTIGGSR"
    assert rows[0]["precursor_mass"] == pytest.approx(505.5 * 2 - 2 * 1.007276) and rows[1]["intensity_array"] == [100.0] and rows[2]["mz_array"] == []
    assert rows[1]["retention_time"] is None and rows[1]["precursor_charge"] == 3


def packed(values, kind="<d", squeeze=True):
    raw = b"".join(struct.pack(kind, v) for v in values)
    return base64.b64encode(zlib.compress(raw) if squeeze else raw).decode()


def test_mzml(tmp_path, spark):
    def array(kind, text, size, squeeze):
        z = '<cvParam accession="MS:1000574"/>' if squeeze else ""
        return f'<binaryDataArray><cvParam accession="{kind}"/><cvParam accession="{size}"/>{z}<binary>{text}</binary></binaryDataArray>'

    def spectrum(n, level):
        return (
            f'<spectrum id="controller=0 scan={n}"><cvParam accession="MS:1000511" value="{level}"/><cvParam accession="MS:1000744" value="400.5"/>'
            f'<cvParam accession="MS:1000041" value="2"/>{array("MS:1000514", packed([100.0, 200.0]), "MS:1000523", True)}'
            f'{array("MS:1000515", packed([1.0, 2.0], "<f", False), "MS:1000521", False)}</spectrum>'
        )

    (tmp_path / "run.mzML").write_text(f'<mzML xmlns="http://x">{spectrum(1, 1)}{spectrum(2, 2)}</mzML>')
    rows = loader.load_spectra(spark, f"{tmp_path}/run.mzML").collect()
    assert len(rows) == 1 and rows[0]["scan_number"] == 2 and rows[0]["mz_array"] == [100.0, 200.0] and rows[0]["intensity_array"] == [1.0, 2.0]
    assert rows[0]["precursor_mz"] == 400.5 and rows[0]["retention_time"] is None and rows[0]["sequence"] == ""


def test_mzxml(tmp_path, spark):
    peaks = packed([10.0, 20.0, 30.0, 40.0], ">f", False)
    (tmp_path / "run.mzxml").write_text(
        f'<mzXML><msRun><scan num="1" msLevel="1"><scan num="2" msLevel="2" retentionTime="PT5.5S"><precursorMz precursorCharge="3">300.5</precursorMz>'
        f'<peaks precision="32">{peaks}</peaks></scan></scan></msRun></mzXML>'
    )
    r = loader.load_spectra(spark, f"{tmp_path}/run.mzxml").first()
    assert r["mz_array"] == [10.0, 30.0] and r["intensity_array"] == [20.0, 40.0] and r["scan_number"] == 2 and r["retention_time"] == 5.5 and r["precursor_charge"] == 3


def test_mixed_sources_and_errors(tmp_path, spark):
    (tmp_path / "a.mgf").write_text(MGF)
    with pytest.raises(ValueError, match="no readable input"):
        loader.load_spectra(spark, "x.unknown")
    df = loader.load_spectra(spark, f"{tmp_path}/a.mgf")
    names = sinks.write_sharded(df, f"{tmp_path}/d", "set", "train", 1)
    assert names == [f"dataset-set-train-{i:04d}-0003.parquet" for i in range(3)]
    both = loader.load_spectra(spark, [f"{tmp_path}/a.mgf", f"{tmp_path}/d/*.parquet"])
    assert both.count() == 6
    custom = loader.load_spectra(spark, ["x", "y"], custom=lambda s, p: df)
    assert custom.count() == 6


def test_metrics_append(tmp_path, spark):
    sinks.append_metrics(spark.createDataFrame([("a", 0.5)], "run string, x double"), f"{tmp_path}/m")
    sinks.append_metrics(spark.createDataFrame([("b", 0.25)], "run string, y double"), f"{tmp_path}/m")
    rows = {r["run"]: r for r in spark.read.option("header", True).csv(f"{tmp_path}/m").collect()}
    assert rows["a"]["x"] == "0.5" and rows["a"]["y"] is None and rows["b"]["y"] == "0.25"


def test_places_in_split_files(tmp_path, spark):
    """Scan numbers count through a file's blocks, and through several files each from 0."""
    for name in ("a", "b"):
        (tmp_path / f"{name}.mgf").write_text("".join(f"BEGIN IONS\nPEPMASS={k + 1}\nCHARGE=2+\n{k} 1\nEND IONS\n\n" for k in range(2000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = loader.read_mgf(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["experiment_name"], r["scan_number"]) for r in rows) == [(n, k) for n in "ab" for k in range(2000)]
    assert all(r["precursor_mz"] == r["scan_number"] + 1 for r in rows)


def test_missing_precursor_is_zero(tmp_path, spark):
    (tmp_path / "run.mzML").write_text('<mzML><spectrum id="scan=1"><cvParam accession="MS:1000511" value="2"/></spectrum></mzML>')
    (tmp_path / "run.mzxml").write_text('<mzXML><msRun><scan num="1" msLevel="2"></scan></msRun></mzXML>')
    for name in ("run.mzML", "run.mzxml"):
        r = loader.load_spectra(spark, f"{tmp_path}/{name}").first()
        assert (r["precursor_mz"], r["precursor_charge"], r["mz_array"]) == (0.0, 0, [])


def test_earlier_predictions_name_what_is_missing(tmp_path, spark):
    (tmp_path / "a.csv").write_text("spectrum_id,prediction\nx,PEP\n")
    (tmp_path / "b.csv").write_text("spectrum_id\ny\n")
    with pytest.raises(ValueError, match="Column 'prediction' does not exist in .*b.csv"):
        loader.read_predictions(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"], "spectrum_id", "prediction")


def test_small_helpers(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from peakloom.functions import masses, tokens
    from peakloom.operators import batches, schema

    assert [masses.isotope_range(x) for x in (None, 3, [1, 2])] == [(0, 1), (0, 3), (1, 2)]
    assert tokens.upgraded({"A": 71.0, "M(ox)": 147.0}) == {"A": 71.0, "M[UNIMOD:35]": 147.0}
    r = spark.createDataFrame([("AI[UNIMOD:35]M", "A"), ("P(x)", "Q?")], "p string, t string").select(tokens.normalised(F.col("p")).alias("n"), tokens.in_vocabulary(F.col("t"), ["A"]).alias("v")).collect()
    assert [tuple(x) for x in r] == [("ALM", True), ("P", False)]
    spectra, mask, precursors = batches.collated([(np.array([1.0, 2.0]), np.array([3.0, 4.0])), (np.zeros(0), np.zeros(0))], np.array([10.0, 5.0]), np.array([2, 1]), 1.0)
    assert spectra.tolist() == [[[1, 3], [2, 4]], [[0, 0], [0, 0]]] and mask.tolist() == [[False, False], [True, True]] and precursors.tolist() == [[18, 2, 10], [4, 1, 5]]
    with pytest.raises(ValueError, match="Missing column"):
        schema.with_metadata(spark.range(1), {}, ("x",))
    with pytest.raises(ValueError, match="differ"):
        schema.union_strict(spark.range(1), spark.range(1).selectExpr("cast(id as int) as id"))
