"""Incremental manifest: a restarted stream appends only the new files."""

import hashlib

from panelcraft.streaming.manifest import append_manifest


def test_manifest_appends_each_file_once(spark, tmp_path):
    land, out, ck = tmp_path / "land", tmp_path / "manifest", tmp_path / "ck"
    land.mkdir()
    (land / "a.csv").write_bytes(b"x,y\n1,2\n")
    q = append_manifest(spark, str(land), str(out), str(ck))
    q.awaitTermination(120)
    (land / "sub").mkdir()
    (land / "sub" / "b.csv").write_bytes(b"z\n")
    q = append_manifest(spark, str(land), str(out), str(ck))
    q.awaitTermination(120)
    rows = {r["path"]: (r["bytes"], r["sha256"]) for r in spark.read.parquet(str(out)).collect()}
    assert rows == {"a.csv": (8, hashlib.sha256(b"x,y\n1,2\n").hexdigest()),
                    "sub/b.csv": (2, hashlib.sha256(b"z\n").hexdigest())}
    assert spark.read.parquet(str(out)).count() == 2
