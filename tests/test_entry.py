import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.001"
SOME = ["contingency", "dice_match", "dice_joined", "dice_atlas_align", "homogeneity", "gram", "mesh_adjacency", "arc_length", "radius_presence", "cosine_sim", "connect_sim_pair", "cosine_distances", "metric_bundle", "metric_sweep_means", "map_metrics", "nearest_vertex", "incomplete_subjects", "matching_folders", "pca_invariants", "pair_fusion", "stage1_vertex_atlas", "stage3_evaluated", "silhouette_adjacent", "cosine_series", "curve_descriptor", "diffusion_coords"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    cur = duck.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in columns]
    text = lambda rows: sorted("|".join("nan" if x is None else repr(float(x)) if isinstance(x, (int, float)) else str(x) for x in r) for r in rows)
    assert text([r[c] for c in columns] for r in df.collect()) == text([r[i] for i in at] for r in cur.fetchall())
