"""SQL view of the stored factor panel."""

from alphaloom.catalog.base import W, roll, view

_RET = '"close" / nullif(lag("close", {n}) OVER (' + W + "), 0) - 1"
view(
    "panel",
    f"""SELECT v.ts_code, trade_date, "close", total_mv AS market_cap, ({_RET.format(n=5)}) * 100 AS mom,
               round(vol / nullif({roll('avg', 'vol', 5)}, 0), 8) AS volr, (high - low) / "close" * 100 AS rng,
               {_RET.format(n=1)} AS return_1d, {_RET.format(n=5)} AS return_5d, industry
        FROM valued v LEFT JOIN basic USING (ts_code)""",
    "valued",
    "basic",
)
