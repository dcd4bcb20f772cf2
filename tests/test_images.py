import numpy as np
import pytest

from marginalia.functions.image import degradation, grey, netpbm
from marginalia.operators.images import triaged, triaged_files


def test_status_and_score_follow_the_measures():
    dice = np.random.default_rng(1)
    page = np.where(dice.random((60, 80)) < 0.15, 90, 210).astype(np.uint8)
    good = degradation(page)
    assert good["status"] == "NORMAL" and not good["reasons"]
    dark, light, flat = degradation(page // 8), degradation(np.full((20, 20), 240)), degradation(np.full((20, 20), 128))
    assert "dark" in dark["reasons"] and dark["score"] > good["score"]
    assert light["reasons"] == ["washed out", "blurred"] and flat["reasons"] == ["blurred"] and flat["score"] == 0.25
    bleed = np.full((60, 80), 240, np.uint8)
    bleed[dice.random((60, 80)) < 0.3] = 60
    assert degradation(bleed)["reasons"] == ["bleed-through"]
    assert degradation(np.empty((0, 0)))["reasons"] == ["empty"] and degradation(np.array([0, 255, 0, 255]))["reasons"] == ["bleed-through"]


def test_grey_of_colours():
    assert grey(np.full((2, 2, 4), 100))[0, 0] in (99, 100) and grey(np.array([[[255, 0, 0]]]))[0, 0] == 76


def test_files_and_rows(spark, tmp_path):
    pixels = bytes([0, 250] * 32)
    (tmp_path / "a.pgm").write_bytes(b"P5\n# made here\n8 8\n255\n" + pixels)
    (tmp_path / "b.ppm").write_bytes(b"P6 2 2 255\n" + bytes(12))
    (tmp_path / "c.pgm").write_bytes(b"P2 2 2 255 0 0 0 0")
    assert netpbm((tmp_path / "a.pgm").read_bytes()).shape == (8, 8)
    rows = {r.name.rsplit("/", 1)[1]: r for r in triaged_files(spark, str(tmp_path)).collect()}
    assert rows["c.pgm"].status == "UNREADABLE" and "dark" in rows["b.ppm"].reasons
    table = spark.createDataFrame([("a", list(pixels), 8), ("n", None, 8)], "name string, pixels array<int>, width int")
    same = {r.name: r for r in triaged(table).collect()}
    assert tuple(same["a"])[1:] == tuple(rows["a.pgm"])[1:] and same["n"].reasons == ["empty"]
    with pytest.raises(ValueError):
        netpbm(b"P5 4 4 255\n")
