"""The materialised star (tables written to the checkpoint folder, concurrently per level) answers
every reused query exactly like the lazy star."""

from shipshape import catalog
from shipshape.plans.star import materialize


def test_materialized_star_matches_lazy(star):
    m = materialize(star)
    for name in ("kpi_orders", "fact_orders", "fact_order_items", "dim_customer", "stg_order_items",
                 "stratified_sample", "category_shares_ci", "repeat_by_first_outcome", "seller_deciles_late"):
        lazy = catalog.round_doubles(catalog.QUERIES[name](star))
        done = catalog.round_doubles(catalog.QUERIES[name](m))
        assert sorted(lazy.columns) == sorted(done.columns), name
        cols = sorted(lazy.columns)
        assert lazy.select(*cols).exceptAll(done.select(*cols)).count() == 0, name
        assert done.select(*cols).exceptAll(lazy.select(*cols)).count() == 0, name
