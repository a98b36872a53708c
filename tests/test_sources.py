import numpy as np
import pytest
from lattica.sources import formats, readers
from lattica.streaming.ingest import ingest_hits


def test_streamlines(spark, tmp_path):
    rng = np.random.default_rng(1)
    lines = [rng.normal(size=(n, 3)).astype("<f4").astype(float) for n in (4, 2, 7)]
    (tmp_path / "a.tck").write_bytes(formats.make_tck(lines))
    matrix = np.array([[2.0, 0, 0, -1], [0, 2, 0, 3], [0, 0, 2, 5], [0, 0, 0, 1]])
    (tmp_path / "b.trk").write_bytes(formats.make_trk(lines, (2, 2, 2), matrix))
    rows = readers.read_streamlines(spark, str(tmp_path)).collect()
    assert len(rows) == 6
    for r in rows:
        assert np.allclose([[p.x, p.y, p.z] for p in r.points], lines[r.curve], atol=1e-5)
    with pytest.raises(ValueError, match="TCK"):
        formats.parse_tck(b"junk")


def test_volumes(spark, tmp_path):
    volume = np.zeros((3, 4, 5))
    volume[1, 2, 3], volume[0, 0, 1] = 0.75, 0.25
    affine = np.array([[1.0, 0, 0, 9], [0, 2, 0, 8], [0, 0, 3, 7], [0, 0, 0, 1]])
    (tmp_path / "v.nii.gz").write_bytes(formats.make_nifti(volume, affine))
    rows = readers.read_voxels(spark, str(tmp_path)).collect()
    assert {(r.i, r.j, r.k, r.value) for r in rows} == {(1, 2, 3, 0.75), (0, 0, 1, 0.25)} and rows[0].m == affine.tolist()
    assert readers.read_voxels(spark, str(tmp_path), threshold=0.5).count() == 1


def test_surfaces_and_labels(spark, tmp_path):
    points, faces = np.arange(12, dtype="f4").reshape(4, 3), np.array([[0, 1, 2], [1, 2, 3]], "i4")
    (tmp_path / "s.surf.gii").write_bytes(formats.make_gifti([("NIFTI_INTENT_POINTSET", points), ("NIFTI_INTENT_TRIANGLE", faces)]))
    rows = readers.read_gifti(spark, str(tmp_path)).collect()
    assert [r.v for r in rows if r.array == 1] == faces.tolist() and len(rows) == 6
    labels = spark.createDataFrame([(0, 0), (1, 3), (2, 3), (3, 1)], "unit int, label int")
    arrays, table = formats.parse_gifti(readers.gifti_labels(labels, "L").first().value.encode())
    assert arrays[0].tolist() == [0, 3, 3, 1] and table[0] == ("Label_0", 1.0, 1.0, 1.0, 0.0) and table[3][4] == 1.0
    other = spark.createDataFrame([(0, 5), (1, 6), (2, 6), (3, 0)], "unit int, label int")
    one, two = readers.gifti_pair(labels, other, "R")
    assert formats.parse_gifti(one.first().value.encode())[1] == formats.parse_gifti(two.first().value.encode())[1]


def test_matrix_and_catalog(spark, tmp_path):
    m = np.array([[0.0, 2.5], [3.0, 0.0]])
    np.save(tmp_path / "m.npy", m)
    assert {(r.row, r.col, r.x) for r in readers.read_npy(spark, str(tmp_path)).collect()} == {(0, 1, 2.5), (1, 0, 3.0)}
    (tmp_path / "c.json").write_text('{"p": ["b", "a"], "q": ["c"]}')
    rows = readers.read_catalog(spark, str(tmp_path / "c.json")).collect()
    assert {tuple(r) for r in rows} == {("p", 0, "b"), ("p", 1, "a"), ("q", 0, "c")}


def test_volume_with_a_fourth_axis(spark, tmp_path):
    (tmp_path / "a.nii").write_bytes(formats.make_nifti(np.ones((2, 2, 2, 1), "<f4"), np.eye(4)))
    assert readers.read_voxels(spark, str(tmp_path / "a.nii")).count() == 8
    (tmp_path / "b.nii").write_bytes(formats.make_nifti(np.ones((2, 2, 2, 3), "<f4"), np.eye(4)))
    with pytest.raises(Exception, match="more than three axes"):
        readers.read_voxels(spark, str(tmp_path / "b.nii")).collect()


def test_ingest_counts_a_subject_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    hits = spark.createDataFrame([("s1", 1, 5), ("s1", 1, 5), ("s2", 2, 6)], "subject string, cluster int, vertex long")
    for rows in (hits, hits):
        rows.write.mode("append").parquet(source)
        ingest_hits(spark, source, out, mark).awaitTermination()
    assert {(r.subject, r.cluster, r.vertex, r.n, r.batch) for r in spark.read.parquet(out).collect()} == {("s1", 1, 5, 2, 0), ("s2", 2, 6, 1, 0)}
    assert spark.read.parquet(out + "_late").groupBy("batch").count().collect()[0].asDict() == {"batch": 1, "count": 3}
    spark.createDataFrame([("s3", 1, 1)], "subject string, cluster int, vertex long").write.mode("append").parquet(source)
    ingest_hits(spark, source, out, mark).awaitTermination()
    assert {r.subject for r in spark.read.parquet(out).collect()} == {"s1", "s2", "s3"}


def test_npy_is_written_and_read(spark, tmp_path):
    m = spark.createDataFrame([(0, 1, 2.0), (3, 0, -1.5), (3, 2, 4.0)], "row int, col int, x double")
    readers.write_npy(m, f"file://{tmp_path}/m.npy", (5, 3))
    want = np.zeros((5, 3))
    want[0, 1], want[3, 0], want[3, 2] = 2, -1.5, 4
    assert np.array_equal(np.load(tmp_path / "m.npy"), want)
    assert {(r.row, r.col, r.x) for r in readers.read_npy(spark, str(tmp_path)).collect()} == {(0, 1, 2.0), (3, 0, -1.5), (3, 2, 4.0)}


def test_folders(spark, tmp_path):
    for name in ("s1/run_a/x.bin", "s1/run_b/deep/run_c/y.bin", "s2/z.bin", "top.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    at = lambda *names: {f"{tmp_path}/{n}" for n in names}
    found = lambda name=None: {r.folder for r in readers.read_folders(spark, str(tmp_path), name).collect()}
    assert found() == at("s1", "s2") and found("run_*") == at("s1/run_a", "s1/run_b", "s1/run_b/deep/run_c")
    assert found("s[!1]") == at("s2") and found("run_?") == found("run_[abc]") == found("run_*") and found("run.a") == set()


def test_runs_of_a_grid(spark, tmp_path):
    from lattica.plans import pipelines as P

    grid = P.parameter_grid(spark, **{"k": [3, 4], "lambda": [0.5], "hemi": ["L", "R"]})
    assert grid.count() == 4
    P.write_runs(grid.withColumn("label", grid["k"] * 10), str(tmp_path / "runs"), ["k", "lambda", "hemi"])
    P.write_runs(grid.where("k = 4").withColumn("label", grid["k"] * 100), str(tmp_path / "runs"), ["k", "lambda", "hemi"])
    assert (tmp_path / "runs/k=4/lambda=0.5/hemi=L").is_dir()
    assert {(r.k, r.hemi, r.label) for r in spark.read.parquet(str(tmp_path / "runs")).collect()} == {(3, "L", 30), (3, "R", 30), (4, "L", 400), (4, "R", 400)}


def test_consensus_finds_two_clusters(spark):
    from lattica.plans import pipelines as P

    rng = np.random.default_rng(2)
    views = {}
    for v in range(2):
        x = np.repeat([[1.0, 0, 0], [0, 1.0, 0]], 8, axis=0) + rng.normal(size=(16, 3)) * 0.02
        views[v] = spark.createDataFrame([(100 + i, r.tolist()) for i, r in enumerate(x)], "row long, v array<double>")
    grid = P.parameter_grid(spark, **{"k": [2], "lambda": [10.0], "rho": [1.0]})
    rows = P.consensus_grid(views, grid, neighbours=4, iterations=5).collect()
    label = {r.row: r.label for r in rows}
    assert len(rows) == 16 and len({label[100 + i] for i in range(8)}) == 1 and len({label[108 + i] for i in range(8)}) == 1 and label[100] != label[108]
