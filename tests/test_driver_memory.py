"""What the registered queries send through the driver, by the plans that have run."""

import re
from functools import cache

import pytest

from polyrun.operators import cluster
from polyrun.plans import queries

#: What the sides that are broadcast are joined by: contigs, samples' coverage, ranges' totals and hot stretches (HOT rows at most).
SMALL = {"ref_id", "sample_idx", "_part", "qgram"}
NAMES = ["best_match", "mapping_counts", "sample_union_order", "feature_lookup", "pairwise_histogram_distance", "context_evidence", "best_reference_ht", "next_ht", "tract_by_id", "frameshift_proxy", "map_edit", "bed", "variable_tracts", "tracts_per_report", "vcf_rows", "selected_tracts"]


@pytest.fixture(scope="module")
def steps():
    """Steps that queries share are made once; gives all tables that were kept so far, with their plans."""
    kept, keep = [], queries.checkpointed

    def noted(df):
        out = keep(df)
        kept.append(df)
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(queries, "checkpointed", noted)
        m.setattr(cluster, "checkpointed", noted)
        for name in ("_unbiased", "_located_of", "_simple_concat", "_simple_ref"):
            m.setattr(queries, name, cache(getattr(queries, name)))
        yield kept


@pytest.mark.parametrize("name", NAMES)
def test_only_catalogues_are_broadcast(spark, steps, name):
    """Spark takes a side for small by its compressed bytes, and then sends it whole through the driver."""
    df = queries.queries()[name](spark, "/root/testdata/sf0.01")
    assert df.collect()
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in [*steps, df]]
    keys = [re.sub(r"#\d+L?", "", k) for p in plans for k in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", p.split("== Initial Plan ==")[0])]
    assert {k for k in keys if k not in SMALL} == set() and not any("BroadcastNestedLoopJoin" in p for p in plans)
