import random
import struct
import zlib
from collections import Counter
from itertools import combinations

import pytest
from lumisift.functions import paths, scoring
from lumisift.operators import faces, features, grouping, review, similarity
from lumisift.operators.components import connected_components
from lumisift.operators.totals import with_totals
from lumisift.plans import cull
from lumisift.sources import scan, tables
from lumisift.streaming import streams
from pyspark.sql import Row
from pyspark.sql import functions as F


def hashes(spark, values):
    return spark.createDataFrame([(f"p{i:03}", i, v) for i, v in enumerate(values)], "path string, seq long, phash long")


def test_hamming(spark):
    rows = spark.createDataFrame([(0, 0), (0, 15), (-1, 0)], "a long, b long")
    assert [r[0] for r in rows.select(similarity.hamming(F.col("a"), F.col("b"))).collect()] == [0, 4, 64]


def groups(df, distance):
    found = {}
    for r in grouping.group_duplicates(df, distance).collect():
        found.setdefault(r.group_rank, []).append((r.member_rank, r.path))
    return [[p for _, p in sorted(found[k])] for k in sorted(found)]


def test_groups(spark):
    assert groups(hashes(spark, [0, 1, 255]), 2) == [["p000", "p001"]]
    assert groups(hashes(spark, [0, 3, 15]), 2) == [["p000", "p001", "p002"]]
    assert groups(hashes(spark, [7, 7, None, None]), 0) == [["p000", "p001"]]
    assert groups(hashes(spark, [7, 7]), -1) == []
    assert groups(hashes(spark, []), 6) == []


@pytest.mark.parametrize("distance, shared", [(-1, 1), (0, 1), (2, 1), (6, 1), (6, 2), (20, 1), (64, 1)])
def test_similar_pairs_equal_brute_force(spark, distance, shared):
    r = random.Random(distance)
    values = [r.getrandbits(64) for _ in range(15)]
    values += [v ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for v in values] + [0, 0, (1 << 63), (1 << 64) - 1]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    want = {(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}
    found = [(p.hash_a, p.hash_b) for p in similarity.similar_pairs(hashes(spark, signed), "phash", distance, shared).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(r.randrange(50), r.randrange(50)) for _ in range(30)] + [(None, 3), (5, None)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    found = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found.get(x, x) == find(x) for x in root)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_totals_of_a_hot_key_are_joined_in_split_partitions(spark):
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 60_000, 1, 8).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
        found = with_totals(rows.union(spark.createDataFrame([(None, 1)], "k long, v long")), "k", F.count("*").alias("n"), F.min("v").alias("least"))
        got = sorted(map(tuple, found.collect()))
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    key = [7 if v % 3 == 0 else v for v in range(60_000)]
    count, least = Counter(key), {}
    for k, v in zip(key, range(60_000), strict=True):
        least.setdefault(k, v)
    assert got == sorted((k, v, count[k], least[k]) for k, v in zip(key, range(60_000), strict=True))


def metrics(*values):
    return Row(**dict(zip(scoring.FACTORS, values, strict=True)))


SCHEMA = "metrics struct<sharpness:double,exposure:double,contrast:double,color:double,composition:double,subject:double>"


def test_overall_score(spark):
    df = spark.createDataFrame([(metrics(100.0, 0.0, 0.0, 0.0, None, None),)], SCHEMA)
    assert df.select(scoring.overall_score(F.col("metrics"), scoring.Weights(1, 1, 0, 0, 1, 1))).first()[0] == 50.0
    assert df.select(scoring.overall_score(F.col("metrics"), scoring.Weights(0, 0, 0, 0, 0, 0))).first()[0] == 0.0
    assert list(scoring.Weights().__dict__.values()) == [0.25, 0.15, 0.10, 0.10, 0.25, 0.15]


def test_priors(spark):
    priors = faces.prior_boxes(spark)
    assert priors.count() == 4420
    first, last = (priors.filter(F.col("prior_idx") == k).first() for k in (0, 4419))
    assert (round(first.cx, 6), round(first.cy, 6), round(first.w, 6)) == (0.0125, round(0.5 / 30, 6), 0.03125)
    assert last.h == 1.0 and round(last.cx, 6) == 0.9


def test_nms_and_main_face(spark):
    boxes = [(1, 0, 0.9, 0.0, 0.0, 0.5, 0.5), (1, 1, 0.8, 0.0, 0.0, 0.5, 0.45), (1, 2, 0.75, 0.4, 0.4, 1.0, 1.0), (2, 0, 0.8, 0.0, 0.0, 0.01, 0.01)]
    df = spark.createDataFrame(boxes, "photo_id long, prior_idx int, face_score float, x1 float, y1 float, x2 float, y2 float")
    assert sorted((r.photo_id, r.prior_idx) for r in faces.nms(df).collect()) == [(1, 0), (1, 2), (2, 0)]
    photos = spark.createDataFrame([(1, 100, 100), (2, 100, 100)], "photo_id long, width int, height int")
    found = faces.main_face(faces.to_pixel_faces(faces.nms(df), photos)).collect()
    assert [(r.photo_id, round(r.face.score, 4)) for r in found] == [(1, 0.75)]


def test_confidence_is_strict_and_priors_end(spark):
    raw = spark.createDataFrame([(1, 0, 0.7, 0.0, 0.0, 0.0, 0.0), (1, 4420, 0.9, 0.0, 0.0, 0.0, 0.0), (1, 5, 0.8, 0.0, 0.0, 0.0, 0.0)], "photo_id long, prior_idx int, face_score float, lx float, ly float, lw float, lh float")
    assert [r.prior_idx for r in faces.decode_boxes(raw).collect()] == [5]


def test_formats(spark):
    names = {"a/b.JPG": "standard", "c.nef": "raw", "d.txt": "unsupported", "e": "unsupported", "x.png/y": "unsupported", None: "unsupported"}
    df = spark.createDataFrame([(k,) for k in names], "path string")
    assert [r[0] for r in df.select(paths.format_class(F.col("path"))).collect()] == list(names.values())
    listed = spark.createDataFrame([("/disqualified/a.png",), ("/disqualified/x/disqualified/b.png",), ("/disqualified/Disqualified/c.png",)], "path string")
    assert [r[0] for r in paths.filter_photo_paths(listed, "path", "/disqualified").collect()] == ["/disqualified/a.png", "/disqualified/Disqualified/c.png"]


def results(spark, rows):
    return spark.createDataFrame([(p, s, h, sc, metrics(m, m, m, m, m, None)) for p, s, h, sc, m in rows], "path string, seq long, phash long, score double, " + SCHEMA)


def test_cull_ties_and_nan(spark):
    nan = float("nan")
    df = results(spark, [("a", 0, 0, 50.0, 10.0), ("b", 1, 1, 50.0, 20.0), ("c", 2, -1, 50.0, 20.0), ("d", 3, 1 << 40, nan, 99.0), ("e", 4, 1 << 41, None, 99.0), ("f", 5, 2, 32.0, 99.0)])
    short, funnel = cull.cull(df, n=10)
    assert [r.path for r in short.collect()] == ["b", "c"]
    assert funnel.first().asDict() == {"total": 6, "after_technical": 3, "after_dedupe": 2, "shown": 2}
    places = [r.path for r in cull.flat_view(df, "score").orderBy("place").collect()]
    assert places == ["a", "b", "c", "f", "d", "e"]
    assert cull.cull(df.limit(0))[0].count() == 0


def test_disqualify(spark):
    df = results(spark, [("/r1/x.png", 0, 0, 1.0, 1.0), ("/r2/x.png", 1, 0, 2.0, 1.0), ("/r1/y.png", 2, 0, 3.0, 1.0), ("/r1/z.png", 3, 0, 99.0, 1.0), ("/r1/n.png", 4, 0, float("nan"), 1.0)])
    plan = review.plan_disqualify(df, 32.0, "/r", spark.createDataFrame([("y.png",)], "file_name string"))
    assert sorted((r.path, r.status) for r in plan.collect()) == [("/r1/x.png", "moved"), ("/r1/y.png", "failed"), ("/r2/x.png", "failed")]
    assert review.remaining_photos(df, plan).count() == 4
    assert {r.status: r.photos for r in review.disqualify_summary(plan).collect()} == {"moved": 1, "failed": 2}


def test_bad_pixels_fail_alone(spark):
    rows = [("ok", 0, 4, 4, bytes(48)), ("short", 1, 4, 4, bytes(47)), ("none", 2, 4, 4, None), ("empty", 3, 0, 0, b"")]
    scored = features.score_photos(spark.createDataFrame(rows, "path string, seq long, width int, height int, rgb binary"))
    good, failed = scan.split_failures(scored)
    assert [r.path for r in good.collect()] == ["ok"] and failed.count() == 3
    assert good.first().metrics.composition == 50.0 and good.first().mode == "landscape"


def png(w, h, channels, data):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(b"\0" + data[k * w * channels : (k + 1) * w * channels] for k in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.fixture
def roll(tmp_path):
    (tmp_path / "disqualified").mkdir()
    for name, body in {"a.png": png(3, 2, 3, bytes(range(18))), "g.PNG": png(2, 2, 1, bytes([1, 2, 3, 4])), "t.png": png(1, 1, 4, bytes([9, 8, 7, 255])), "bad.jpg": b"nothing", "n.txt": b"text", "r.nef": b"raw", "disqualified/d.png": png(1, 1, 3, b"abc"), "_DSC1.png": png(1, 1, 3, b"abc"), ".t.jpg": b"x", "_n.txt": b"x", "_n.nef": b"raw", "_a b/.%20v_é.png": png(2, 1, 3, b"fedcba"), "disqualified/_d.png": png(1, 1, 3, b"abc")}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    return str(tmp_path)


def test_scan_files(spark, roll):
    found, failures, thumbs = scan.scan(spark, roll)
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == [".%2520v_é.png", "_DSC1.png", "a.png", "g.PNG", "t.png"]
    assert sorted(r.path.rsplit("/", 1)[1] for r in failures.collect()) == [".t.jpg", "_n.nef", "bad.jpg", "r.nef"]
    sizes = {r.path.rsplit("/", 1)[1]: (r.width, r.height, bytes(r.rgb)) for r in thumbs.collect()}
    assert sizes["a.png"] == (3, 2, bytes(range(18))) and sizes["g.PNG"][2] == bytes([1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4])
    assert sizes[".%2520v_é.png"] == (2, 1, b"fedcba") and sizes["_DSC1.png"][2] == b"abc"
    assert {r.path.rsplit("/", 1)[0] for r in found.collect() if "DSC" in r.path or "a.png" in r.path} == {f"file://{roll}"}
    listed = [r.path[r.path.index(roll) + len(roll) + 1 :] for r in scan.list_photos(spark, roll).collect()]
    assert sorted(listed) == [".t.jpg", "_DSC1.png", "_a b/.%20v_é.png", "_n.nef", "a.png", "bad.jpg", "g.PNG", "r.nef", "t.png"]


def test_hidden_photos_out_of_reach_are_failures(spark, roll, monkeypatch):
    gone = spark.createDataFrame([(f"file:{roll}/_gone.png", f"file://{roll}/_gone.png", True)], "path string, uri string, hidden boolean")
    monkeypatch.setattr(scan, "walk", lambda *_: gone)
    found, failures, _ = scan.scan(spark, roll)
    assert found.count() == 3
    assert "_gone.png" in "".join(r.path for r in failures.collect() if "can't be read or copied" in r.error)


def test_scan_stream(spark, roll, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("stream"))
    last = streams.run_available(streams.scan_stream(spark, roll), streams.table_sink(f"{out}/t"), f"{out}/c")
    rows = spark.read.parquet(f"{out}/t/version={last}")
    assert rows.filter("error IS NULL").count() == 3 and rows.filter("error IS NOT NULL").count() == 2


FACES = "path string, face struct<x1:float,y1:float,x2:float,y2:float,score:float>"


def test_overrides_use_faces(spark):
    pixels = random.Random(6).randbytes(40 * 30 * 3)
    photos = spark.createDataFrame([("a", 1, 40, 30, pixels), ("b", 2, 40, 30, pixels)], "path string, seq long, width int, height int, rgb binary")
    found = spark.createDataFrame([("a", (4.0, 5.0, 16.0, 19.0, 0.9))], FACES)

    def plain(rows):
        return {r.path: (r.mode, r.score, tuple(r.metrics)) for r in rows.collect()}

    want = plain(features.score_photos(photos, "portrait", found))
    assert want["a"][1] != want["b"][1] and want["a"][2][5] is not None and want["b"][2][5] is None
    to = {m: photos.select("path", F.lit(m).alias("mode")) for m in ("portrait", "landscape")}
    for mode in ("landscape", "object", "auto"):
        scored = features.score_photos(photos, mode, found)
        assert plain(review.apply_overrides(scored, to["portrait"])) == want
        away = review.apply_overrides(scored, to["landscape"])
        assert plain(away) == plain(features.score_photos(photos, "landscape", found))
        assert plain(review.apply_overrides(away, to["portrait"])) == want


def test_scan_takes_faces(spark, roll, tmp_path_factory):
    path = next(r.path for r in scan.scan(spark, roll)[0].collect() if r.path.endswith("a.png"))
    found = spark.createDataFrame([(path, (0.0, 0.0, 2.0, 2.0, 0.9))], FACES)
    modes = {r.path: r.mode for r in scan.scan(spark, roll, faces=found)[0].collect()}
    assert modes[path] == "portrait" and sum(m == "portrait" for m in modes.values()) == 1
    out = str(tmp_path_factory.mktemp("stream"))
    last = streams.run_available(streams.scan_stream(spark, roll, faces=found), streams.table_sink(f"{out}/t"), f"{out}/c")
    rows = spark.read.parquet(f"{out}/t/version={last}").filter("error IS NULL")
    assert [r.path for r in rows.filter("mode = 'portrait'").collect()] == [path]


def test_similar_pairs_of_many_and_crowded_hashes(spark, monkeypatch):
    r = random.Random(9)
    hashes = [r.getrandbits(64) for _ in range(40)] + [r.getrandbits(12) for _ in range(300)] + [0, (1 << 64) - 1]
    signed = sorted({h - (1 << 64) if h >> 63 else h for h in hashes})
    df = spark.createDataFrame([(h,) for h in signed * 2] + [(None,)], "phash long")
    monkeypatch.setattr(similarity, "TILE", 50)
    for distance in (3, 6, 14):
        want = sorted((a, b, ((a ^ b) & (1 << 64) - 1).bit_count()) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance)
        assert sorted(map(tuple, similarity.similar_pairs(df, max_distance=distance).collect())) == want and want
    assert similarity.similar_pairs(df.limit(0)).count() == 0


def test_keys_get_rarer_with_the_number_of_hashes():
    assert [similarity.shared_blocks(n, 6) for n in (1000, 10**5, 10**8, 10**12)] == [1, 2, 3, 4]


EVENTS = "path string, seq long, status string"


def stream_of(spark, folder):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def test_upserts_over_batches_and_resumed_runs(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    r, events = random.Random(3), []
    add = lambda rows: spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)
    for k in range(3):
        events += (new := [(f"p{r.randrange(30)}", 100 * k + i, "ok") for i in range(20)])
        add(new)
        last = streams.run_available(stream_of(spark, source), streams.upsert_sink(out, buckets=4), checkpoint)
        assert last == k == streams.run_available(stream_of(spark, source), streams.upsert_sink(out, buckets=4), checkpoint)
        want = {}
        for p, seq, _ in events:
            want[p] = max(want.get(p, -1), seq)
        found = streams.read_upserted(spark, out, spark.createDataFrame([], EVENTS).schema)
        assert {x.path: x.seq for x in found.collect()} == want
    add([("new", 900, "ok"), (events[0][0], 901, "ok")])
    streams.run_available(stream_of(spark, source), streams.upsert_sink(out, only_known=True, buckets=4), checkpoint)
    found = {x.path: x.seq for x in streams.read_upserted(spark, out, spark.createDataFrame([], EVENTS).schema).collect()}
    assert "new" not in found and found[events[0][0]] == 901 and len(found) == len(want)
    streams.forget(spark, out, checkpoint)
    assert streams.last_batch(spark, checkpoint) is None and streams.read_upserted(spark, out, spark.createDataFrame([], EVENTS).schema).count() == 0


def test_running_stream(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    spark.createDataFrame([("a", 1, "ok"), ("b", 2, "failed")], EVENTS).coalesce(1).write.parquet(source)
    query = streams.started(streams.progress_stream(stream_of(spark, source)), streams.table_sink(out), checkpoint, "complete")
    try:
        query.processAllAvailable()
        assert {x.status: x.photos for x in spark.read.parquet(f"{out}/version={streams.last_batch(spark, checkpoint)}").collect()} == {"ok": 1, "failed": 1}
    finally:
        query.stop()


def test_results_and_thumbs_are_written(spark, roll, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("written"))
    found, _, thumbs = scan.scan(spark, roll)
    scan.write_results(found, f"{out}/r")
    scan.write_thumbs(thumbs, f"{out}/t")
    assert spark.read.parquet(f"{out}/r").count() == 5 and spark.read.parquet(f"{out}/t").columns == ["path", "width", "height", "rgb"]


def test_large_photos_shrink(spark):
    pixels = bytes(range(256)) * (1800 * 300 * 3 // 256 + 1)
    photos = spark.createDataFrame([("a", 1, 1800, 300, pixels[: 1800 * 300 * 3])], "path string, seq long, width int, height int, rgb binary")
    row = features.score_photos(photos, thumbs=True).first()
    assert (row.width, row.height) == (1600, 267) and (row.thumb.width, row.thumb.height) == (220, 37)
    assert len(features.detector_input(photos).first().tensor) == 3 * 240 * 320


def test_no_shared_folder_on_a_cluster():
    class Context:
        master, applicationId = "spark://somewhere:7077", "x"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    with pytest.raises(ValueError, match="share"):
        tables.scratch_dir(type("S", (), {"sparkContext": Context()})())
