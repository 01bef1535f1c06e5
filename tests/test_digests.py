"""Content digests do not depend on how the work is dealt."""

import hashlib
import json
import random

import pytest

from flankline.sources import digests


def by_hand(folder, chunk):
    rows = []
    for p in sorted(folder.rglob("*")):
        if p.is_file():
            data = p.read_bytes()
            parts = [hashlib.sha256(data[s : s + chunk]).hexdigest() for s in range(0, max(1, len(data)), chunk)]
            rows.append([str(p.relative_to(folder)), hashlib.sha256("".join(parts).encode()).hexdigest()])
    return hashlib.sha256(json.dumps(sorted(rows)).encode()).hexdigest()


@pytest.mark.parametrize("through_spark", [False, True])
def test_digests(spark, tmp_path, through_spark):
    rng = random.Random(1)
    folder = tmp_path / "in"
    (folder / "deep ü").mkdir(parents=True)
    for name, size in (("a", 1000), ("b", 0), ("deep ü/c", 777), ("deep ü/d", 64)):
        (folder / name).write_bytes(rng.randbytes(size))
    for chunk in (64, 100, 1 << 20):
        assert digests.digest(spark, str(folder), chunk, through_spark) == by_hand(folder, chunk)
    assert len({digests.digest(spark, str(folder / n), 100, through_spark) for n in ("a", "deep ü/c")}) == 2
    with pytest.raises(FileNotFoundError):
        digests.digest(spark, str(tmp_path / "nowhere"))


def test_manifest(spark, tmp_path):
    (tmp_path / "x").write_text("one")
    first = digests.manifest(spark, {"b": 1, "a": [2]}, {"x": str(tmp_path / "x")}, "scan", 7)
    assert first == digests.manifest(spark, {"a": [2], "b": 1}, {"x": str(tmp_path / "x")}, "scan", 7)
    assert first["versions"]["spark"] and len(first["run_hash"]) == 64
    digests.write_manifest(spark, first, str(tmp_path / "manifest.json"))
    assert json.loads((tmp_path / "manifest.json").read_text()) == first
    (tmp_path / "x").write_text("two")
    assert digests.manifest(spark, {"b": 1, "a": [2]}, {"x": str(tmp_path / "x")}, "scan", 7)["run_hash"] != first["run_hash"]
