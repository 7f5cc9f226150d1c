import struct
import zlib

import numpy as np
import pytest

from tessera.operators import report
from tessera.sources import images, readers


def png(pixels, filters):
    h, w, n = pixels.shape
    lines = b""
    padded = np.zeros((h + 1, w + 1, n), int)
    padded[1:, 1:] = pixels
    for y in range(h):
        kind = filters[y % len(filters)]
        cur, left, up, corner = padded[y + 1, 1:], padded[y + 1, :-1], padded[y, 1:], padded[y, :-1]
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0, left, up, (left + up) // 2, paeth][kind]
        lines += bytes([kind]) + ((cur - guess) & 255).astype(np.uint8).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def written(spark, path, pixels, kind):
    """A file of that kind by the JVM's own writer; returns what its reader makes of it, as rows of (red, green, blue)."""
    jvm = spark._jvm
    h, w, _ = pixels.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for y in range(h):
        for x in range(w):
            r, g, b = map(int, pixels[y, x])
            image.setRGB(x, y, (r << 16) | (g << 8) | b)
    file = jvm.java.io.File(str(path))
    assert jvm.javax.imageio.ImageIO.write(image, kind, file)
    back = jvm.javax.imageio.ImageIO.read(file)
    flat = [back.getRGB(x, y) & 0xFFFFFF for y in range(h) for x in range(w)]
    return np.array([(v >> 16, v >> 8 & 255, v & 255) for v in flat], np.uint8).reshape(h, w, 3)


@pytest.mark.parametrize("kind", ["jpg", "png", "bmp", "tif"])
def test_every_kind_is_decoded(spark, tmp_path, kind):
    y, x = np.mgrid[0:24, 0:32]
    pixels = np.stack([x * 8, y * 10, 255 - x * 4], 2).astype(np.uint8)
    seen = written(spark, tmp_path / f"one.{kind}", pixels, kind)
    assert np.abs(seen.astype(int) - pixels).max() <= (0 if kind != "jpg" else 60)
    got = images.image_features(spark, str(tmp_path)).first()
    want = images.statistics(seen)
    assert got.stem == "one" and all(abs(got[c] - want[c]) < 1e-12 for c in images.STATISTICS)


def test_png_of_every_filter(spark, tmp_path):
    for channels in (1, 3):
        pixels = np.random.default_rng(0).integers(0, 256, (10, 7, channels)).astype(np.uint8)
        (tmp_path / f"c{channels}.png").write_bytes(png(pixels, [0, 1, 2, 3, 4]))
        got = images.image_features(spark, str(tmp_path)).where(f"stem = 'c{channels}'").first()
        want = images.statistics(pixels)
        assert all(got[c] == want[c] or abs(got[c] - want[c]) < 1e-12 for c in images.STATISTICS)


def test_folders_have_roles_and_patterns(spark, tmp_path):
    for folder, name in (("train", "AB_{:06d}.pgm"), ("val", "img_{:04d}.pgm"), ("other", "x{}.PGM")):
        (tmp_path / folder).mkdir()
        for i in range(3):
            (tmp_path / folder / name.format(i)).write_bytes(b"P5 1 1 255\n\x00")
    got = {r.folder.rsplit("/", 1)[1]: (r.n, r.role, r.pattern) for r in images.image_folders(spark, str(tmp_path), 3).collect()}
    assert got == {"train": (3, "train", "panel"), "val": (3, "val", "number"), "other": (3, "flat", "generic")}
    assert images.image_folders(spark, str(tmp_path), 4).isEmpty()


def test_levels_come_from_all_images(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.4,), (0.9,), (None,)], "img_mean double")
    assert np.allclose(images.brightness_levels(df), (0.175, 0.525)) and images.brightness_levels(df.limit(0)) == (0.25, 0.75)


def test_the_link_is_chosen_by_the_share_of_rows(spark):
    stems = spark.createDataFrame([(f"img_{i:04d}", 0.1) for i in range(40)] + [(f"a_{i}", 0.2) for i in range(40)] + [("file7", 0.3)], "stem string, img_mean double")
    rows = [(i, "a", i, f"x/file{i}.png", f"none{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "id int, g string, t int, file string, text string")
    forms = images.link_forms(df, "file", ["g", "t"], "id")
    assert [f for f, _ in forms] == ["hint:file", "column:g", "column:text", "pair:g+t", "index:id"]
    shares = {r.form: r.share for r in images.link_shares(df, stems, forms).collect()}
    assert shares == {"hint:file": 0.05, "column:g": 0.0, "column:text": 0.0, "pair:g+t": 1.0, "index:id": 1.0}
    out, form = images.with_images(df, stems, "file", ["g", "t"])
    assert form == "pair:g+t" and out.columns == [*df.columns, "img_mean"] and {r.img_mean for r in out.collect()} == {0.2}
    out, form = images.with_images(df.drop("t"), stems, "file", ["g"], ["id"])
    assert form == "index:_row" and {r.img_mean for r in out.collect()} == {0.1} and out.count() == 20
    more = stems.union(spark.createDataFrame([("file3", 0.4)], stems.schema))
    out, form = images.with_images(df, more, "file", ["g", "t"])
    assert form == "hint:file" and {r.id: r.img_mean for r in out.where("img_mean is not null").collect()} == {3: 0.4, 7: 0.3}
    out, form = images.with_images(df.select("id", "text"), stems)
    assert form is None and out.columns == ["id", "text"]


def test_image_table_and_its_link(spark, tmp_path):
    for i in range(11):
        (tmp_path / f"a_{i}.pgm").write_bytes(b"P5 4 4 255\n" + bytes([i * 20] * 16))
    (tmp_path / "a_99.png").write_bytes(b"\x89PNG broken")
    (tmp_path / "rgb_1.png").write_bytes(png(np.full((4, 4, 3), 255, np.uint8), [0]))
    assert images.image_folders(spark, str(tmp_path)).first().n == 13
    rows = images.link_images(spark.createDataFrame([("a", 3), ("a", 99), ("rgb", 1), ("z", 1)], "g string, t int"), images.image_features(spark, str(tmp_path)), ["g", "t"])
    got = {(r.g, r.t): r for r in rows.collect()}
    assert abs(got["a", 3].img_mean - 60 / 255) < 1e-9 and got["a", 3].img_channel_range is None
    assert got["rgb", 1].img_bright == 1.0 and got["rgb", 1].img_channel_range == 0.0
    assert got["a", 99].img_mean is None and got["z", 1].img_mean is None


def test_folder_of_csvs(spark, tmp_path):
    (tmp_path / "b.csv").write_text("k,y\n1,2.5\n2,\n")
    (tmp_path / "a.csv").write_text("k,x\n1,text\n")
    tables, warnings = readers.read_csvs(spark, str(tmp_path))
    assert list(tables) == ["a.csv", "b.csv"] and not warnings and dict(tables["b.csv"].dtypes) == {"k": "int", "y": "double"}
    assert readers.columns_of(spark, str(tmp_path / "a.csv")) == ["k", "x"]
    assert readers.layout(str(tmp_path)) == "flat" and readers.target_file(tables, "y", []) == "b.csv"
    for d in ("train", "val"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "covariates.csv").write_text("k\n1\n")
    assert readers.layout(str(tmp_path)) == "subfolder" and set(readers.layout_tables(spark, str(tmp_path))) == {"train", "val"}


@pytest.mark.parametrize(
    ("text", "target"),
    [
        ("| `price` | double | the TARGET to predict |\nPredict `other`.", "price"),
        ("| `id` | an id |\n| `sales` | TARGET |", "sales"),
        ("Predict `demand` for each store.", "demand"),
        ("**Target**: `load`", "load"),
        ("The target variable is risk.", "risk"),
        ("the target column = `y2`", "y2"),
        ("Targets are met by all.", None),
        ("", None),
    ],
)
def test_targets_of_descriptions(text, target):
    assert readers.described_target(text) == target


def test_columns_named_like_time_and_groups():
    d = readers.describe("Columns `store_id`, `week`, `sale_date` and `x`; see `train_week.csv`.")
    assert d["time_columns"] == ["sale_date", "week"] and d["group_columns"] == ["store_id"]


def test_known_names_of_codebooks_come_first(spark, tmp_path):
    import json

    book = {f"id{i:02d}": f"2024-01-{i:02d}" for i in range(1, 31)}
    ids = spark.createDataFrame([(f"id{i:02d}",) for i in range(1, 9)], "id string")
    write = lambda name, content: (tmp_path / name).write_text(content if isinstance(content, str) else json.dumps(content))
    write("a_period.json", book)
    write("other.json", book)
    assert readers.find_codebook(spark, str(tmp_path), ids, "id").name == "a_period.json"  # other.json is named as none
    write("Time_Codebook.JSON".replace("JSON", "json"), {v: k for k, v in book.items()})
    got = readers.find_codebook(spark, str(tmp_path), ids, "id")
    assert (got.name, got.direction) == ("Time_Codebook.json", "date_to_id") and got.dates == book
    write("dates.json", "no json")
    write("period_id.json", {k: book[k] for k in list(book)[:9]})
    assert [p.name for p in readers.codebook_files(str(tmp_path))] == ["Time_Codebook.json", "dates.json", "period_id.json", "a_period.json"]
    assert readers.find_codebook(spark, str(tmp_path), ids, "id").name == "Time_Codebook.json"
    assert readers.find_codebook(spark, str(tmp_path), ids.limit(6), "id") is None  # 6 of the 20 sampled ids are not over 30 %


def test_file_maps(tmp_path):
    tables = {"cov.csv": ["k", "x"], "tgt.csv": ["k", "y"], "both.csv": ["k", "x", "y"]}
    split = readers.file_map(tables, "y", ["cov.csv", "tgt.csv"], ["v.csv"], ["s.csv"])
    assert (split["convention"], split["train_data"], split["train_target"], split["val_features"], split["sample_submission"]) == ("split", "cov.csv", "tgt.csv", "v.csv", "s.csv")
    one = readers.file_map(tables, "y", ["both.csv"], [], [])
    assert one["convention"] == "combined" and one["train_data"] == one["train_target"] == "both.csv" and one["train_target_in_combined_file"] and one["val_features"] is None
    assert readers.file_map(tables, None, ["cov.csv"], [], [])["train_target"] == "cov.csv" and readers.file_map({}, "y", [], [], [])["train_data"] is None
    (tmp_path / "val").mkdir()
    assert readers.subfolder_map(str(tmp_path), "y", "t.csv", [])["val_features"] == "val/covariates.csv"
    (tmp_path / "test").mkdir()
    assert readers.subfolder_map(str(tmp_path), "y", None, ["s.csv"])["val_features"] == "test/covariates.csv"


def test_description_and_codebook(spark, tmp_path):
    (tmp_path / "Data-Description.md").write_text("The target is `sales`.\n\n| Column | Meaning |\n| --- | --- |\n| `store` | a store |\n| `week` | the week |\n\n`train_a.csv` is for training, `val_b.csv` for validation.\n")
    d = readers.describe(readers.find_description(str(tmp_path)).read_text())
    assert d["target"] == "sales" and d["columns"] == ["store", "week"] and d["files"] == ["train_a.csv", "val_b.csv"] and d["time_words"] == ["week"]
    readers.write_json({f"p{i}": f"2024-{i:02d}-01" for i in range(1, 13)}, str(tmp_path / "periods.json"))
    readers.write_json({"few": "1"}, str(tmp_path / "a.json"))
    ids = spark.createDataFrame([(f"p{i}",) for i in range(1, 9)], "id string")
    found = readers.find_codebook(spark, str(tmp_path), ids, "id")
    assert len(found.dates) == 12 and found.direction == "id_to_date"
    assert readers.find_codebook(spark, str(tmp_path), ids.where("id = 'none'"), "id") is None
    assert readers.load_contracts({"a": str(tmp_path / "a.json"), "b": "nowhere"}) == ({"a": {"few": "1"}}, ["b"])


def test_csv_out_and_back(spark, tmp_path):
    readers.write_csv(spark.createDataFrame([(2, 1.5), (1, 0.5)], "row_id int, y double"), str(tmp_path / "out"), ["row_id"])
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "out"), "row_id int, y double").collect()] == [(1, 0.5), (2, 1.5)]


def test_report_and_log(spark, tmp_path):
    text = report.report("Run", {"forecast": "later", "quality": spark.createDataFrame([(1, 0.12345)], "n int, x double")}, time_axis=False)
    assert "| 1 | 0.1235 |" in text and "later" not in text
    with pytest.raises(ValueError):
        report.report("Run", {"other": ""})
    log = report.Log(str(tmp_path / "log.jsonl"))
    log.add("rejected_hypothesis", names=list(range(30)))
    assert len(log.read()[0]["names"]) == 10 and report.preflight() == [] and report.preflight(spark="99.0")
    with pytest.raises(ValueError):
        log.add("nonsense")
