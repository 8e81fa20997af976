"""Drawing files end to end: read, processed, stored, and taken from a stream."""

import json

import pytest

from roomwright.plans import engine
from roomwright.sources import dxf, store
from roomwright.streaming.ingest import watch


def drawing(width):
    """Two rooms of 4 x 3 and width x 3 metres, a gap of 1 m between them, a bed in the first, a label in the second, more than
    5 from the first one's centre, which would take it otherwise."""
    end = 4 + width
    lines = [(0, 0, end, 0), (0, 3, end, 3), (0, 0, 0, 3), (end, 0, end, 3), (4, 0, 4, 1), (4, 2, 4, 3)]
    groups = ["0", "SECTION", "2", "HEADER", "9", "$INSUNITS", "70", "6", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES"]
    for x0, y0, x1, y1 in lines:
        groups += ["0", "LINE", "8", "A-WALL", "10", x0, "20", y0, "11", x1, "21", y1]
    groups += ["0", "ARC", "8", "A-DOOR", "10", 4, "20", 1, "40", 1.0, "50", 0, "51", 90]
    groups += ["0", "INSERT", "8", "F", "2", "BED_1", "10", 1, "20", 1, "0", "TEXT", "8", "T", "10", 3 + width, "20", 1.5, "1", "Kitchen", "0", "ENDSEC", "0", "EOF"]
    return "\n".join(map(str, groups)) + "\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    place = tmp_path_factory.mktemp("drawings")
    for name, width in (("a.dxf", 5), ("b.DXF", 5.5)):
        (place / name).write_text(drawing(width))
    (place / "empty.dxf").write_text("0\nEOF\n")
    (place / "notes.txt").write_text("no drawing")
    return place


def check(payload, width):
    rooms = sorted(json.loads(payload)["floors"][0]["rooms"], key=lambda r: r["area_sqft"])  # fusion puts the best match first
    assert [r["name"] for r in rooms] == ["Bedroom", "Kitchen"]
    assert [r["area_sqft"] for r in rooms] == [pytest.approx(12 * 10.7639, abs=0.01), pytest.approx(3 * width * 10.7639, abs=0.01)]
    assert [r["doors"] for r in rooms] == [1, 1] and rooms[0]["furniture"] == ["BED"] and rooms[0]["adjacent"] == ["Kitchen"]


@pytest.mark.parametrize("use_raster", [False, True])
def test_files(spark, folder, use_raster):
    got = {r.drawing_id.rpartition("/")[2]: r for r in engine.process_files(spark, str(folder), use_raster=use_raster, raster_size=128).collect()}
    assert got.keys() == {"a.dxf", "b.DXF"}
    check(got["a.dxf"].payload, 5)
    check(got["b.DXF"].payload, 5.5)


def test_older_engine_sees_one_room(spark, folder):
    """It bridges no gaps."""
    rows = engine.run_pipeline_v1(engine.from_dxf(dxf.read_dxf(spark, str(folder)), every_instance=True))["rooms"].collect()
    assert sorted(r.area_raw for r in rows) == [pytest.approx(27), pytest.approx(28.5)]


def test_store(spark, folder, tmp_path):
    result = engine.run_pipeline(engine.from_dxf(dxf.read_dxf(spark, str(folder))), use_raster=False)
    store.save(result, str(tmp_path), result["rooms"].selectExpr("drawing_id", "'completed' status").distinct())
    one = result["rooms"].where("drawing_id like '%a.dxf'").first().drawing_id
    assert store.load(spark, str(tmp_path), "rooms").count() == 4
    assert {r.name for r in store.load(spark, str(tmp_path), "rooms", one).collect()} == {"Bedroom", "Kitchen"}
    assert store.load(spark, str(tmp_path), "doors", one).count() == 1
    assert store.load(spark, str(tmp_path), "rooms", "nowhere").count() == 0
    older = store.with_columns_of(spark.createDataFrame([(1, "x")], "room_no long, name string"), "room_no long, name string, confidence double")
    assert older.columns == ["room_no", "name", "confidence"] and older.first().confidence is None


def test_stream(spark, folder, tmp_path):
    for _ in range(2):  # the second run finds nothing new
        query = watch(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"), once=True, use_raster=False)
        query.awaitTermination(120)
        assert query.exception() is None
    got = {r.drawing_id.rpartition("/")[2]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    check(got["a.dxf"].payload, 5)
    assert got["empty.dxf"].status == "no_rooms_detected"
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)


def test_file_kinds(spark):
    rows = spark.createDataFrame([("a.DXF",), ("b.dwg",), ("c.pdf",)], "path string")
    assert [r.status for r in dxf.file_status(rows).collect()] == ["uploaded", "unsupported", "rejected"]


def test_each_file_has_its_own_unit(spark, tmp_path):
    """The same two rooms in millimetres, feet and metres, and files that are broken in places."""
    def scaled(times, unit):
        out, codes = [], drawing(5).split("\n")
        for code, value in zip(codes[::2], codes[1::2]):
            out += [code, str(float(value) * times) if code in ("10", "11", "20", "21", "40") else unit if code == "70" else value]
        return "\n".join(out) + "\n"

    files = {"mm.dxf": scaled(1000, "4"), "feet.dxf": scaled(1 / 0.3048, "2"), "m.dxf": drawing(5), "none.dxf": drawing(5).replace("$INSUNITS\n70\n6", "$INSUNITS\n70\n?")}
    broken = "0\nINSERT\n2\nX\n10\noops\n20\n1\n0\nINSERT\n2\nX\n10\n1\n20\n1\n0\nATTRIB\n1\nT\n10\nbad\n0\nSEQEND\n"
    files["m.dxf"] = files["m.dxf"].replace("2\nENTITIES\n", "2\nENTITIES\n" + broken)
    for name, content in files.items():
        (tmp_path / name).write_text(content)
    rows = engine.vector_rooms(engine.from_dxf(dxf.read_dxf(spark, str(tmp_path)))).collect()
    got = {}
    for r in rows:
        got.setdefault(r.drawing_id.rpartition("/")[2], []).append(round(r.area_sqft, 1))
    assert {k: sorted(v) for k, v in got.items()} == {n: [pytest.approx(129.2, abs=0.2), pytest.approx(161.5, abs=0.2)] for n in files}


def test_converter_and_uploads(spark, tmp_path):
    (tmp_path / "a.DWG").write_bytes(drawing(5).encode()[::-1])
    (tmp_path / "b.dwg").write_bytes(b"?")

    def convert(raw):
        if raw == b"?":
            raise ValueError("broken")
        return raw[::-1].decode()

    got = {r.drawing_id.rpartition("/")[2]: r for r in dxf.read_dwg(spark, str(tmp_path), convert).collect()}
    assert got["a.DWG"].content == drawing(5) and got["b.dwg"].content is None and got["b.dwg"].error == "broken"
    rows = spark.createDataFrame([(1, "x.dxf", b"0\nEOF\n"), (2, "y.dwg", b"?"), (3, "z", None)], "drawing_id long, name string, raw binary")
    assert [(r.drawing_id, r.status, r.content) for r in dxf.uploads(rows).orderBy("drawing_id").collect()] == [(1, "uploaded", "0\nEOF\n"), (2, "unsupported", None), (3, "rejected", None)]
