"""Images of more lines, of lines far down and of pixels that lack a polarisation give the rows of the SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from echogrid.plans import registry

registry.load()
SF = "/root/testdata/sf0.001"
c = F.col


def both(spark, folder, name):
    """Rows of a query and of its SQL over the embeddings in ``folder``."""
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, folder)
    names = ", ".join(df.columns)
    want = db.execute(f"SELECT {names} FROM ({registry.SQL[name]}) ORDER BY ALL").fetchall()
    plain = lambda r: tuple(None if v is None or v != v else float(v) for v in r)
    return sorted(map(plain, df.collect()), key=repr), sorted(map(plain, want), key=repr)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    # Lines that the first 90 s of the track do not pass.
    far = e.where("vec_id < 40").withColumn("vec_id", c("vec_id") + 20000)
    kinds = {"far": far, "short": e.where("vec_id < 498"), "shorter": e.where("vec_id < 497"), "down": e.where("vec_id < 56").withColumn("vec_id", c("vec_id") + 40000)}
    out = {}
    for k, d in kinds.items():
        out[k] = str(tmp_path_factory.mktemp(k))
        d.write.parquet(f"{out[k]}/embeddings.parquet")
    return out


@pytest.mark.parametrize("name", ["a13_area_projection", "a16_area_projection", "a16_facet_areas", "a52_normalisation_layers", "l4_static_layers"])
def test_lines_beyond_the_first_states_are_passed(spark, tables, name):
    found, want = both(spark, tables["far"], name)
    if name == "a16_area_projection":
        # Areas of a million square metres hang on shares worked out from differences of 1e-7 cells: the last digit may differ.
        assert [r[:2] for r in found] == [r[:2] for r in want]
        assert [x for r in found for x in r] == pytest.approx([x for r in want for x in r], abs=1)
    else:
        assert found == want
    assert found


@pytest.mark.parametrize("kind", ["short", "shorter"])
@pytest.mark.parametrize("name", ["l2_covariance_map", "l2_terrain_corrected_map"])
def test_pixels_that_lack_a_polarisation_count(spark, tables, kind, name):
    found, want = both(spark, tables[kind], name)
    assert found == want


def test_ramps_of_lines_far_down(spark, tables):
    found, want = both(spark, tables["down"], "a37_ramp_removal")
    assert found == want and all(v is not None for _, _, v in found)
