"""Raw previews, orientation, listing, moves, the detector hook, removals, and the cull on rows as a scan returns them."""

import itertools
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from lumisift.functions import boxes, pixels
from lumisift.operators import faces, features, grouping, ordering, review, similarity
from lumisift.plans import cull
from lumisift.sources import embedded, listing, moving, scan
from lumisift.streaming import streams
from pyspark.sql import functions as F


def png(w, h, data):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(b"\0" + data[k * w * 3 : (k + 1) * w * 3] for k in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def jpeg(spark):
    """Makes JPEG bytes of a size, dark but for a bright top left quarter, by Java's image writer."""
    jvm = spark._jvm

    def made(w, h):
        image = jvm.java.awt.image.BufferedImage(w, h, 1)
        for x, y in itertools.product(range(w // 2), range(h // 2)):
            image.setRGB(x, y, 0xFFFFFF)
        out = jvm.java.io.ByteArrayOutputStream()
        jvm.javax.imageio.ImageIO.write(image, "jpg", out)
        return bytes(out.toByteArray())

    return made


def exif(turn, order="<"):
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IHHHIHHI", 8, 1, 0x112, 3, 1, turn, 0, 0)


def with_exif(raw, turn, order="<"):
    body = exif(turn, order)
    return raw[:2] + b"\xff\xe1" + struct.pack(">H", 8 + len(body)) + b"Exif\0\0" + body + raw[2:]


def tiff(order, directories, pictures, magic=42):
    """A TIFF-like file: for each directory a list of (tag, type, value or ('at', picture) or ('size', picture)); SubIFDs by ('ifd', n)."""
    places, at = {}, 8
    for k, d in enumerate(directories):
        places[k] = at
        at += 2 + 12 * len(d) + 4
    where = {}
    for name, body in pictures.items():
        where[name] = at
        at += len(body)
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", magic, 8)
    for d in directories:
        out += struct.pack(order + "H", len(d))
        for tag, kind, value in d:
            if isinstance(value, tuple):
                value = {"at": lambda n: where[n], "size": lambda n: len(pictures[n]), "ifd": lambda n: places[n]}[value[0]](value[1])
            out += struct.pack(order + "HHI", tag, kind, 1) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
        out += struct.pack(order + "I", 0)
    return out + b"".join(pictures.values())


def reading(raw):
    return lambda at, n: raw[at : at + n]


LOSSLESS = b"\xff\xd8\xff\xc3\x00\x0b\x08" + struct.pack(">HH", 4000, 6000) + b"\x01\x01\x11\x00"


def raws(jpeg):
    small, large = jpeg(16, 8), jpeg(64, 32)
    sensor = [(0x103, 3, 7), (0x111, 4, ("at", "sensor")), (0x117, 4, ("size", "sensor"))]
    nef = tiff(">", [[(0x112, 3, 6), (0x14A, 4, ("ifd", 1))], [(0x201, 4, ("at", "large")), (0x202, 4, ("size", "large"))]], {"large": large})
    cr2 = tiff("<", [[(0x103, 3, 6), (0x111, 4, ("at", "large")), (0x117, 4, ("size", "large")), (0x14A, 4, ("ifd", 1))], [(0x201, 4, ("at", "small")), (0x202, 4, ("size", "small"))]], {"small": small, "large": large})
    dng = tiff("<", [[(0x112, 3, 1), (0x14A, 4, ("ifd", 1))], [*sensor, (0x14A, 4, ("ifd", 2))], [(0x103, 3, 7), (0x111, 4, ("at", "large")), (0x117, 4, ("size", "large"))]], {"sensor": LOSSLESS, "large": large})
    arw = tiff("<", [[(0x112, 3, 3), (0x201, 4, ("at", "large")), (0x202, 4, ("size", "large"))]], {"large": with_exif(large, 8)})
    raf = b"FUJIFILMCCD-RAW".ljust(84, b"\0") + struct.pack(">II", 92, len(large)) + large
    orf = tiff("<", [[(0x201, 4, ("at", "large")), (0x202, 4, ("size", "large"))]], {"large": large}, magic=0x4F52)
    none = tiff("<", [sensor], {"sensor": LOSSLESS})
    return {"a.NEF": nef, "b.cr2": cr2, "c.dng": dng, "d.arw": arw, "e.raf": raf, "f.orf": orf, "_g.nef": nef, "none.dng": none, "short.nef": nef[:30], "loop.cr2": tiff("<", [[(0x14A, 4, 8)]], {}), "empty.arw": b"", "text.rw2": b"no raw photo"}


def test_previews_and_orientations(jpeg):
    files, large = raws(jpeg), jpeg(64, 32)
    for name in ("b.cr2", "c.dng", "e.raf", "f.orf"):
        assert embedded.preview(reading(files[name])) == large, name
    assert embedded.orientation(reading(embedded.preview(reading(files["a.NEF"])))) == 6
    assert embedded.preview(reading(files["d.arw"])) == with_exif(large, 8)
    for name in ("none.dng", "short.nef", "loop.cr2", "empty.arw", "text.rw2"):
        assert embedded.preview(reading(files[name])) is None, name
    for turn, order in itertools.product(range(1, 9), "<>"):
        assert embedded.orientation(reading(with_exif(large, turn, order))) == turn
        assert embedded.orientation(reading(exif(turn, order))) == turn
    for raw in (large, b"", b"\xff\xd8", b"\xff\xd8\xff\xe1\x00\x10Exif\0\0II", with_exif(large, 9), png(1, 1, b"abc")):
        assert embedded.orientation(reading(raw)) == 1
    r = random.Random(1)
    for name in files:  # whatever bytes are damaged, nothing breaks
        for _ in range(60):
            raw = bytearray(files[name] or b"x")
            for _ in range(4):
                raw[r.randrange(min(len(raw), 80))] = r.randrange(256)
            embedded.preview(reading(bytes(raw[: r.randrange(len(raw) + 1)])))


def test_raw_and_turned_photos_are_scanned(spark, jpeg, tmp_path):
    for name, body in raws(jpeg).items():
        (tmp_path / name).write_bytes(body)
    for turn in range(1, 9):
        (tmp_path / f"t{turn}.jpg").write_bytes(with_exif(jpeg(64, 32), turn))
    found, failures, _ = scan.scan(spark, str(tmp_path))
    sizes = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.orientation) for r in found.collect()}
    assert sizes == {f"t{k}.jpg": ((64, 32, k) if k < 5 else (32, 64, k)) for k in range(1, 9)} | {n: (64, 32, 1) for n in ("b.cr2", "c.dng", "e.raf", "f.orf")} | {"a.NEF": (32, 64, 6), "_g.nef": (32, 64, 6), "d.arw": (32, 64, 8)}
    assert {r.path.rsplit("/", 1)[1]: r.error for r in failures.collect()} == dict.fromkeys(("none.dng", "short.nef", "loop.cr2", "empty.arw", "text.rw2"), "no preview picture found in the raw photo")
    photos = {r.path.rsplit("/", 1)[1]: np.frombuffer(r.rgb, np.uint8).reshape(r.height, r.width, 3) for r in scan.read_photos(spark, str(tmp_path)).filter("error IS NULL").collect()}
    upright = photos["t1.jpg"]
    for turn, corner in {1: (0, 0), 2: (0, 1), 3: (1, 1), 4: (1, 0), 5: (0, 0), 6: (0, 1), 7: (1, 1), 8: (1, 0)}.items():
        h, w = photos[f"t{turn}.jpg"].shape[:2]
        bright = {(y, x): photos[f"t{turn}.jpg"][(2 * y + 1) * h // 4, (2 * x + 1) * w // 4].mean() > 128 for y in (0, 1) for x in (0, 1)}
        assert [k for k, v in bright.items() if v] == [corner], turn
    assert np.array_equal(photos["b.cr2"], upright)


def test_walk_lists_all_names_level_by_level(spark, tmp_path):
    for name in ("a/b/c/_x.png", "a/.h/y.jpg", "disqualified/z.png", "a/disqualified/z.png", "not disqualified/w é%20.png", "v.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    rows = {r.path.removeprefix(f"file:{tmp_path}/"): r for r in listing.walk(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a/b/c/_x.png", "a/.h/y.jpg", "not disqualified/w é%20.png", "v.txt"}
    assert {n for n, r in rows.items() if r.hidden} == {"a/b/c/_x.png", "a/.h/y.jpg"} and {r.length for r in rows.values()} == {5}
    assert rows["not disqualified/w é%20.png"].uri == f"file://{tmp_path}/not%20disqualified/w%20é%2520.png"
    assert listing.walk(spark, str(tmp_path / "a/b/c")).count() == 1


def copies(tmp_path):
    r = random.Random(3)
    noise, other = r.randbytes(12 * 12 * 3), r.randbytes(12 * 12 * 3)
    for name, data in {"a1": noise, "a2": noise, "a3": noise, "b": other}.items():
        (tmp_path / f"{name}.png").write_bytes(png(12, 12, data))
    return str(tmp_path)


def test_cull_of_scanned_copies(spark, tmp_path):
    results, _, _ = scan.scan(spark, copies(tmp_path))
    assert results.filter("seq IS NOT NULL").isEmpty()
    found, funnel = cull.cull(results, technical=0.0)
    assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == ["a1.png", "b.png"]
    assert tuple(funnel.first()) == (4, 4, 2, 2)
    groups = grouping.group_duplicates(results, 6)
    assert [r.path.rsplit("/", 1)[1] for r in groups.orderBy("member_rank").collect()] == ["a1.png", "a2.png", "a3.png"]
    assert grouping.best_of_group(groups, results).first().path.endswith("a1.png")
    assert {r.title for r in grouping.group_sections(groups, results).collect()} == {"Group (3)"}
    assert cull.flat_view(results).orderBy("place").count() == 4


def test_moves_are_made_once(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    results, _, _ = scan.scan(spark, copies(tmp_path))
    results = results.union(results.filter("path LIKE '%b.png'").withColumn("path", F.lit(f"file://{tmp_path}/sub/b.png")))
    (tmp_path / "sub/b.png").write_bytes(b"other")
    (tmp_path / "disqualified").mkdir()
    (tmp_path / "disqualified/a2.png").write_bytes(b"kept")
    there = spark.createDataFrame([("a2.png",)], "file_name string")
    plan = review.plan_disqualify(results, 1e12, f"file://{tmp_path}", there).cache()
    outcomes = moving.move_aside(plan)
    assert Counter(r.status for r in outcomes.collect()) == Counter(r.status for r in plan.collect()) == {"moved": 3, "failed": 2}
    assert sorted(p.name for p in (tmp_path / "disqualified").iterdir()) == ["a1.png", "a2.png", "a3.png", "b.png"]
    assert (tmp_path / "disqualified/a2.png").read_bytes() == b"kept" and (tmp_path / "sub/b.png").exists()
    assert outcomes.filter("now").count() == 3 and moving.left_after(results, outcomes).count() == 2
    again = moving.move_aside(plan)  # as a task that runs twice
    assert again.filter("now").isEmpty() and again.filter("status = 'moved'").count() == 3
    # a target that came into being after the plan is not written over
    late = moving.move_aside(spark.createDataFrame([(f"file://{tmp_path}/sub/b.png", f"file://{tmp_path}/disqualified/b.png", "moved", None), (f"file://{tmp_path}/no.png", f"file://{tmp_path}/disqualified/no.png", "moved", None)], "path string, target string, status string, error string"))
    assert sorted(r.error for r in late.collect()) == ["photo is gone", "target exists"] and (tmp_path / "sub/b.png").exists()


def made_model():
    """A model whose scores and boxes follow from the tensor; it fails for images of one colour."""

    def model(tensors):
        scores, raw = np.zeros((len(tensors), 4420), np.float32), np.zeros((len(tensors), 4420, 4), np.float32)
        for k, t in enumerate(tensors):
            if t.std() < 1e-6:
                raise RuntimeError("no contrast")
            seed = np.random.default_rng(int(abs(t).sum() * 10) % (1 << 31))
            at = seed.choice(4420, 40, replace=False)
            scores[k, at] = seed.uniform(0.5, 1, 40)
            raw[k, at] = seed.normal(0, 1, (40, 4))
        return scores, raw

    return model


def test_detector_inside_the_scan_equals_the_tables(spark):
    r, model = np.random.default_rng(5), made_model()
    images = [r.integers(0, 256, (30, 40, 3), np.uint8).tobytes() for _ in range(12)] + [bytes(30 * 40 * 3)]
    photos = spark.createDataFrame([(f"p{k:02}", k, 40, 30, rgb) for k, rgb in enumerate(images)], "path string, seq long, width int, height int, rgb binary")
    inside = {x.path: x for x in features.score_photos(photos, "auto", detector=model).collect()}
    rows = []
    for k, rgb in enumerate(images[:-1]):
        scores, raw = model(pixels.detector_tensor(np.frombuffer(rgb, np.uint8).reshape(1, 30, 40, 3)))
        rows += [(k, p, float(scores[0, p]), *map(float, raw[0, p])) for p in np.flatnonzero(scores[0]).tolist()]
    table = spark.createDataFrame(rows, "photo_id long, prior_idx int, face_score float, lx float, ly float, lw float, lh float")
    found = faces.detect_main_faces(table, photos.withColumnRenamed("seq", "photo_id")).join(photos.withColumnRenamed("seq", "photo_id").select("photo_id", "path"), "photo_id")
    outside = {x.path: x for x in features.score_photos(photos, "auto", found).collect()}
    assert set(inside) == set(outside) and len(inside) == 13
    assert sum(x.face is not None for x in inside.values()) > 8 and inside["p12"].face is None and inside["p12"].error is None
    for path, x in inside.items():
        y = outside[path]
        assert (x.face is None) == (y.face is None) and x.mode == y.mode and x.score == pytest.approx(y.score)
        if x.face is not None:
            assert tuple(x.face) == pytest.approx(tuple(y.face), abs=1e-3) and x.metrics.subject == pytest.approx(y.metrics.subject, abs=1e-3)

    def broken(tensors):
        raise MemoryError

    assert features.score_photos(photos, "auto", detector=broken).filter("error IS NULL AND face IS NULL").count() == 13
    assert np.allclose(boxes.priors(), [list(r)[1:] for r in faces.prior_boxes(spark).orderBy("prior_idx").collect()])


def test_stream_takes_hidden_and_raw_photos_once(spark, jpeg, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("roll"), str(tmp_path_factory.mktemp("stream"))
    (root / "a.png").write_bytes(png(3, 2, bytes(range(18))))
    (root / "_DSC1.png").write_bytes(png(1, 1, b"abc"))
    (root / "r.cr2").write_bytes(raws(jpeg)["b.cr2"])
    shown, seen = f"file://{out}/shown", []

    def run():
        scan.show_photos(spark, str(root), shown)
        streams.run_available(streams.scan_stream(spark, str(root), shown=shown), lambda batch, _: seen.extend(r.path.rsplit("/", 1)[1] for r in batch.select("path").collect()), f"{out}/c")

    run()
    assert sorted(seen) == ["_DSC1.png", "a.png", "r.cr2"]
    (root / ".later.png").write_bytes(png(1, 1, b"xyz"))
    run()
    assert sorted(seen) == [".later.png", "_DSC1.png", "a.png", "r.cr2"]


def test_removed_photos_stay_gone(spark, tmp_path):
    schema = "path string, seq long, score double"
    out, sink = str(tmp_path / "t"), streams.upsert_sink(str(tmp_path / "t"), buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    read = lambda: {r.path: r.score for r in streams.read_upserted(spark, out, rows(("", 0, 0.0)).schema).collect()}
    sink(rows(("a", 1, 1.0), ("b", 1, 1.0), ("c", 1, 1.0)), 0)
    streams.remove_paths(out, rows(("a", 0, 0.0)))
    assert read() == {"b": 1.0, "c": 1.0}
    sink(rows(("a", 2, 2.0), ("b", 2, 2.0)), 1)  # a late update of the moved photo
    streams.remove_paths(out, rows(("a", 0, 0.0)))
    assert read() == {"b": 2.0, "c": 1.0}
    streams.upsert_sink(out, buckets=4)(rows(("c", 3, 3.0), ("a", 3, 3.0)), 2)  # after a restart
    assert read() == {"b": 2.0, "c": 3.0}
    streams.forget(spark, out)
    sink(rows(("a", 1, 5.0)), 0)
    assert read() == {"a": 5.0}


def test_updates_without_numbers_have_one_winner(spark):
    rows = [("a", None, float(k)) for k in range(20)]
    schema = "path string, seq long, score double"
    found = {review.upsert_results(df, df.limit(0), "seq").first().score for df in (spark.createDataFrame(rows, schema).repartition(k) for k in (1, 3, 7))}
    assert len(found) == 1


def test_pixels_are_read_once_for_pairs(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = spark.range(500).selectExpr("id * 7919 AS phash").mapInPandas(counted, "phash long")
    similarity.similar_pairs(rows, "phash", 6).count()
    assert seen.value == 500


def test_clashing_names_are_kept_by_ranks(spark):
    df = spark.createDataFrame([(k, 9, "b", "x") for k in range(10)], "id long, part__ int, base__ string, _part__ string")
    found = ordering.global_rank(df, [F.col("id")], "place").orderBy("id").collect()
    assert [(r.id, r.part__, r.base__, r["_part__"], r.place) for r in found] == [(k, 9, "b", "x", k + 1) for k in range(10)]
