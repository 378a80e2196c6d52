"""Groups of tickers: median, spread, breadth, and a member's standing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IN_LINE, BLOC, SCATTERED, LEAST = 3.0, 4.0, 10.0, 2


def cohesion(dispersion: Column) -> Column:
    return F.when(dispersion.isNull(), "unknown").when(dispersion <= BLOC, "bloc").when(dispersion >= SCATTERED, "scattered").otherwise("mixed")


def sector_view(members: DataFrame, returns: DataFrame) -> DataFrame:
    """``members``: sector, ticker; ``returns``: ticker, ret. Unpriced members are named, not counted as flat."""
    joined = members.join(returns, "ticker", "left")
    priced = F.when(F.col("ret").isNotNull(), F.struct(F.col("ret"), F.col("ticker")))
    per = joined.groupBy("sector").agg(
        F.median("ret").alias("mid"), F.stddev_pop("ret").alias("spread"), F.count("ret").alias("n"),
        F.count_if(F.col("ret") > 0).alias("n_up"), F.sort_array(F.collect_list(priced)).alias("r"),
        F.sort_array(F.collect_list(F.when(F.col("ret").isNull(), F.col("ticker")))).alias("missing"),
    )
    enough = F.col("n") >= LEAST
    names = lambda keep: F.array_join(F.transform(F.filter("r", keep), lambda s: s["ticker"]), ",")
    return per.select(
        "sector", "n", F.when(enough, F.col("mid")).alias("median_return"), F.when(enough, F.col("spread")).alias("dispersion"),
        F.when(enough, cohesion(F.col("spread"))).otherwise("unknown").alias("cohesion"), F.when(enough, F.col("n_up")).alias("breadth_up"),
        F.when(enough, names(lambda s: s["ret"] > F.col("mid") + IN_LINE)).alias("leaders"),
        F.when(enough, names(lambda s: s["ret"] < F.col("mid") - IN_LINE)).alias("laggards"), F.array_join("missing", ",").alias("missing"),
    )


def standing(view: DataFrame, members: DataFrame, returns: DataFrame) -> DataFrame:
    """Each priced member against its group; ``carried``: it went with a group that moved as one."""
    rows = members.join(returns.where("ret is not null"), "ticker").join(view, "sector").where("median_return is not null")
    gap = F.col("ret") - F.col("median_return")
    position = F.when(gap > IN_LINE, "leading").when(gap < -IN_LINE, "lagging").otherwise("in_line")
    return rows.select("sector", "ticker", F.col("ret").alias("own_return"), "median_return", gap.alias("gap"), position.alias("position"), "cohesion", ((F.col("cohesion") == "bloc") & (position == "in_line")).alias("carried"))


def sector_line(horizon: int = 30) -> Column:
    """One sentence for a row of ``sector_view``."""
    shape = F.when(F.col("cohesion") == "bloc", "moving together").when(F.col("cohesion") == "unknown", "unclear").otherwise(F.col("cohesion"))
    told = F.concat_ws("; ",
        F.concat(F.format_string(f"%s: median %+.1f%% over {horizon}d, %d/%d up, ", F.col("sector"), F.col("median_return"), F.col("breadth_up"), F.col("n")), shape),
        F.when(F.col("leaders") != "", F.concat(F.lit("leading "), F.replace("leaders", F.lit(","), F.lit(", ")))),
        F.when(F.col("laggards") != "", F.concat(F.lit("lagging "), F.replace("laggards", F.lit(","), F.lit(", ")))),
        F.when(F.col("missing") != "", F.concat(F.lit("no data for "), F.replace("missing", F.lit(","), F.lit(", ")))))
    return F.when(F.col("median_return").isNull(), F.format_string("%s: not enough history (%d members priced).", F.col("sector"), F.col("n"))).otherwise(F.concat(told, F.lit(".")))
