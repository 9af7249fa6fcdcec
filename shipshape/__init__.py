"""shipshape: order-fulfilment and satisfaction analytics as Spark DataFrame plans.

Layers (each a function returning a lazy DataFrame):

* ``sources``   – read the input tables, bind them to the order/item/review/payment model,
                  CSV / JSON / Parquet readers and writers.
* ``functions`` – Column helpers (ratios, bands, Wilson interval, masking, measure packs).
* ``plans``     – staging, dimensions and facts of the star schema.
* ``operators`` – analytical operators on top of the star (KPIs, profiling, quality checks,
                  validation, cuts, deciles, cohorts, sampling, coding statistics, what-if,
                  measure registry with filter context).
"""

__all__ = ["session"]
