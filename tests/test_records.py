"""Rows put together, sizes of pictures, exports and positions, on small cases."""

import io
import math
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from atlasweave.functions import geo, labels
from atlasweave.operators import aggregates, checks, records, review
from atlasweave.sources import readers, sinks

ROW = "cluster int, k int, games array<string>, cabs array<string>, src array<string>, links map<string,string>, game_counts map<string,int>, count_evidence map<string,string>, addr string, pref string, notes string, lat double, lng double, approx boolean"


def test_united_rows_lose_nothing(spark):
    rows = [
        (1, 1, ["a"], [], ["ziv"], {"ziv": "z1", "gmaps": "g"}, {"a": 9, "b": 1}, {"a": "ziv_listed"}, None, "", "n1", 1.0, 2.0, True), (1, 2, ["b", "a"], ["c"], ["ziv", "allnet"], {"ziv": "z2", "allnet": "s"}, {"a": 2}, {"a": "bemanicn_qty"}, "street", "P", "n2", 3.0, 4.0, False),
        (1, 3, None, None, ["ziv"], {"ziv": "z1", "also": "z9"}, None, None, "other", None, "n1", None, None, None), (2, 4, ["x"], [], [], None, None, None, None, None, None, None, None, None),
    ]
    got = {r.cluster: r for r in records.united_rows(spark.createDataFrame(rows, ROW).repartition(3), "cluster", F.col("k")).collect()}
    one = got[1]
    assert (one.games, one.cabs, one.src) == (["a", "b"], ["c"], ["allnet", "ziv"]) and one.links == {"ziv": "z1", "allnet": "s"} and one.also == ["z2", "z9"]
    assert one.game_counts == {"a": 2, "b": 1} and one.count_evidence == {"a": "bemanicn_qty"} and (one.addr, one.pref, one.notes) == ("street", "P", "n1 | n2")
    assert (one.lat, one.lng, one.approx) == (3.0, 4.0, False) and got[2].games == ["x"] and got[2].links is None and got[2].lat is None


def test_corrections_prune_what_rests_on_a_dropped_game(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], {"a": 1, "b": 2}, {"b": "ziv_comment"}, 1.0, 2.0, True), (2, ["a"], {"a": 3}, {}, None, None, None)], "id int, games array<string>, game_counts map<string,int>, count_evidence map<string,string>, lat double, lng double, approx boolean")
    fixes = spark.createDataFrame([(1, ["a", "c"], "closed for good", 5.0, 6.0, {"c": 4, "z": 9})], "id int, games array<string>, closed_reason string, lat double, lng double, game_counts map<string,int>")
    got = {r.id: r for r in records.corrected(rows, fixes).collect()}
    assert got[1].games == ["a", "c"] and got[1].game_counts == {"a": 1, "c": 4} and got[1].count_evidence == {"c": "ziv_comment"} and got[1].closed and (got[1].lat, got[1].lng, got[1].approx) == (5.0, 6.0, True)
    assert got[2].games == ["a"] and got[2].game_counts == {"a": 3} and not got[2].closed


def test_guard_fails_the_job(spark):
    old = spark.createDataFrame([("a",)] * 100 + [("b",)] * 60 + [("c",)] * 10, "g string")
    fine = spark.createDataFrame([("a",)] * 98 + [("b",)] * 60 + [("c",)] * 6, "g string")
    records.require_guarded(aggregates.snapshot_diff(old, fine, "g"))
    with pytest.raises(ValueError, match="b: vanished.*total"):
        records.require_guarded(aggregates.snapshot_diff(old, fine.where("g <> 'b'"), "g"))


def test_pins_by_id_and_by_name(spark):
    pins = spark.createDataFrame([(1, "Alpha  Place", 1.0, 1.0, "u"), (2, "Moved", 2.0, 2.0, "u"), (3, "No Source", 3.0, 3.0, " "), (4, "Other", 4.0, 4.0, "u")], "id int, name string, lat double, lng double, source_url string")
    rows = spark.createDataFrame([(1, "alpha place"), (9, "MOVED"), (3, "No Source"), (4, "Not the same"), (8, None)], "id int, name string")
    assert {r.id: r.pin_lat for r in records.hand_placed(rows, pins).collect()} == {1: 1.0, 9: 2.0, 3: None, 4: None, 8: None}


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", h, w) + b"\x03" * 8


def test_sizes_of_pictures(spark):
    files = [
        (b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 640, 480), ("png", 640, 480)), (b"GIF89a" + struct.pack("<HH", 12, 34), ("gif", 12, 34)), (jpeg(800, 600), ("jpeg", 800, 600)),
        (b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"), ("webp", 100, 50)), (b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 10 + struct.pack("<HH", 320, 200), ("webp", 320, 200)),
        (b"RIFF\0\0\0\0WEBPVP8L" + b"\0" * 5 + (9 | 19 << 14).to_bytes(4, "little") + b"\0" * 6, ("webp", 10, 20)), (b"", (None, None, None)), (None, (None, None, None)), (b"\xff\xd8\xff", (None, None, None)), (b"text", (None, None, None)),
    ]
    rows = spark.createDataFrame([(k, bytearray(b) if b is not None else None) for k, (b, _) in enumerate(files)], "k int, b binary").select("k", readers.image_size("b").alias("s")).orderBy("k").collect()
    assert [tuple(r.s) for r in rows] == [w for _, w in files]


def test_mercator_metres(spark):
    """Against the plain formula, and a landmark whose degrees are known to some hundred metres."""
    points = [(12958160.97, 4825907.72), (-1000.0, -500.0), (0.0, 13000000.0), (5e6, 9e6), (5e6, 6e6), (5e6, 2e6)]
    df = spark.createDataFrame(points, "x double, y double")
    lat, lng = geo.mercator_to_bd("x", "y")
    for r in df.select("x", "y", lat.alias("lat"), lng.alias("lng")).collect():
        c = next(c for low, c in geo.MERCATOR_BANDS if abs(r.y) >= low)
        t = abs(r.y) / c[9]
        assert math.isclose(r.lat, math.copysign(sum(p * t**k for k, p in enumerate(c[2:9])), r.y), abs_tol=1e-9) and math.isclose(r.lng, math.copysign(c[0] + c[1] * abs(r.x), r.x), abs_tol=1e-9)
    first = df.select(lat.alias("lat"), lng.alias("lng")).first()
    assert abs(first.lat - 39.91) < 0.05 and abs(first.lng - 116.40) < 0.05


def test_sheet_begins_with_a_mark(spark, tmp_path):
    rows = spark.createDataFrame([("A, b", None, 1.0, 2.0, "X", ["g"], [], ["s", "t"])], "name string, addr string, lat double, lng double, country string, games array<string>, cabs array<string>, src array<string>")
    sinks.write_csv(sinks.sheet(rows).coalesce(1), str(tmp_path / "out"), spreadsheet=True)
    text = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbfname,address,lat,lng,country,games,cabinets,source") and b'"A, b","",1.0000000,2.0000000,X,g,"",s;t' in text
    same = [r.value for r in sinks.stable_json(rows, [F.col("name")]).collect()]
    assert same == ['{"addr":null,"cabs":[],"country":"X","games":["g"],"lat":1.0,"lng":2.0,"name":"A, b","src":["s","t"]}']


def test_changes_are_idempotent(spark):
    rng = random.Random(3)
    now = spark.createDataFrame([(k, rng.choice("ab"), rng.choice([None, 1, 2])) for k in range(30)], "id int, s string, n int")
    new = spark.createDataFrame([(k, rng.choice(["a", "b", None]), rng.choice([None, 1, 2])) for k in range(10, 40)], "id int, s string, n int")
    after = review.applied(now, new, "id", ["s", "n"])
    assert after.count() == 40 and {r.action for r in review.changed(now, new, "id", ["s", "n"]).collect()} == {"add", "change", "same"}
    again = review.changed(after, new, "id", ["s", "n"]).collect()
    assert {r.action for r in again} == {"same"} and not any(r.fields for r in again)


def test_labels(spark):
    row = spark.range(1).select(labels.interpolated(F.lit("{a} of {b} {c}"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))).alias("t"), labels.highlighted(F.lit("In Rome"), F.lit("rom")).alias("h"), labels.highlighted(F.lit("x"), F.lit("")).alias("none")).first()
    assert row.t == "1 of 2 {c}" and tuple(row.h) == (3, 6) and row.none is None


def test_gates_of_answers(spark):
    rows = [
        (1, 30.0, 110.0, "甲市", "某路1号", "甲市东区某路2号", "东区", None), (2, 30.0, 110.0, "甲市", "某路1号", "甲市西区别路1号", "东区", "district"), (3, 30.0, 110.0, "甲市", "某路12号", "甲市西区某路12号", "东区", None),
        (4, 30.0, 110.0, "甲市", "某路1号", "甲市某处", "东区", None), (5, 5.0, 110.0, "甲市", "", "", None, "box"), (6, 30.0, 119.0, "甲市", "", "", None, "distance"), (7, 30.0, 110.0, "乙市", "", "", None, "city"), (8, None, None, "甲市", "", "", None, "position"), (9, 30.0, 110.0, "甲市", "某路1号", "甲市西区", None, None),
    ]
    df = spark.createDataFrame([r[:-1] for r in rows], "id int, lat double, lng double, city string, addr string, answer string, district string")
    df = df.withColumns({"area_lat": F.lit(30.0), "area_lng": F.lit(110.0), "radius_km": F.lit(120.0), "area_city": F.lit("甲"), "districts": F.array(F.lit("东区"), F.lit("西区"))})
    got = {r.id: r.refused_by for r in checks.geocode_gate(df, box=(17.5, 54.0, 73.0, 135.5)).collect()}
    assert got == {r[0]: r[-1] for r in rows}


def test_related_areas(spark):
    areas = spark.createDataFrame([("p", "吉林", None, 0), ("c1", "长春", "p", 1), ("c2", "吉林", "p", 1), ("d1", "榆树", "c1", 2), ("d2", "船营", "c2", 2)], "area_id string, base string, parent string, depth int")
    cases = {("长春", "榆树"): True, ("榆树", "长春"): True, ("吉林", "榆树"): False, ("吉林", "船营"): True, ("长春", "吉林"): True, ("榆树", "船营"): False, ("无", "无"): True, ("无", "长春"): False}
    got = checks.related_areas(spark.createDataFrame(list(cases), "want string, got string"), areas).collect()
    assert {(r.want, r.got): r.related for r in got} == cases and len(got) == len(cases)


def test_zipped_layers(spark):
    marks = spark.createDataFrame([("one", "a", "x", 1.0, 2.0, 1), ("two", "b", "y", 1.0, 2.0, 2), ("two", "c", "z", 1.0, 2.0, 3)], "layer string, name string, about string, lat double, lng double, id int")
    files = {r.file: bytes(r.content) for r in sinks.kmz_files(marks, "layer", [F.col("id")], 1).collect()}
    assert set(files) == {"one.kmz", "two_a.kmz", "two_b.kmz"}
    with zipfile.ZipFile(io.BytesIO(files["two_b.kmz"])) as z:
        assert z.namelist() == ["doc.kml"] and "<name>c</name>" in z.read("doc.kml").decode()


def test_units_of_official_files(spark, tmp_path):
    (tmp_path / "sdvx.json").write_text('[{"name": "A", "address": "x", "lat": 0, "lng": 0}, {"name": " ", "address": "y"}]')
    (tmp_path / "sdvx_vm.json").write_text('[{"name": "A", "address": "x ", "lat": 1.0, "lng": 2.0}]')
    (tmp_path / "unknown.json").write_text('[{"name": "B", "address": "z"}]')
    rows = readers.of_families(readers.official_rows(spark, str(tmp_path)))
    got = readers.units(rows).collect()
    assert [(r.source, r.name, r.games, r.cabs, r.lat, r.also) for r in got] == [("eagate", "A", ["sdvx"], ["sdvx_vm"], 1.0, [])]


def test_units_fold_counts_by_evidence(spark):
    schema = "name string, address string, lat double, lng double, source string, source_url string, notes string, games array<string>, game_counts map<string,int>, count_evidence map<string,string>, load_at struct<file:string,place:int>"
    rows = [
        ("V", "s", None, None, "ziv", "u1", "n1", ["a"], {"a": 9, "b": 0}, {"a": "ziv_listed"}, ("f", 1)), ("V", "s", 1.0, 2.0, "ziv", "u2", "n2", [], {"a": 3, "c": 2}, {"a": "ziv_comment"}, ("f", 2)), ("V", "s", None, None, "ziv", "u1", "n1", None, None, None, ("e", 1)),
        ("V", "s", None, None, "bemanicn", None, None, None, {"a": 4}, None, ("f", 9)),
    ]
    got = {r.source: r for r in readers.units(spark.createDataFrame(rows, schema).repartition(3)).collect()}
    one = got["ziv"]
    assert one.game_counts == {"a": 3, "c": 2} and one.count_evidence == {"a": "ziv_comment", "c": "ziv_listed"} and one.games == ["a", "c"] and (one.source_url, one.also, one.notes, one.lat) == ("u1", ["u2"], "n1 | n2", 1.0)
    assert got["bemanicn"].count_evidence == {"a": "bemanicn_qty"}
