"""Host routing of URLs to outlets.

The outlet registry is configuration of a handful of rows, so routing is one
CASE expression over constants (no join, no shuffle): the first outlet in
registry order whose domain is a substring of the lower-cased host (the
reference behaviour), or with ``mode='longest'`` the longest domain that the
host equals or ends with after a dot.  An explicit hint names the outlet
directly; an unknown hint routes to the generic lane (null).  A registry that is a table of any size is
met by equi-joins on hosts (:func:`route_table`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.functions import text as T


def route(url, outlets: Sequence[tuple[str, str]], mode: str = "first", hint=None) -> Column:
    """Outlet key for ``url`` given (key, domain) pairs in registry order; null = generic."""
    host = T.url_host(F.col(url) if isinstance(url, str) else url, lower=True)
    out = F.lit(None).cast("string")
    if mode == "first":
        for key, dom in reversed(list(outlets)):
            out = F.when(F.contains(host, F.lit(dom)), F.lit(key)).otherwise(out)
    elif mode == "longest":
        ranked = sorted(enumerate(outlets), key=lambda x: (len(x[1][1]), -x[0]))
        for _, (key, dom) in ranked:
            hit = (host == F.lit(dom)) | host.endswith(F.lit("." + dom))
            out = F.when(hit, F.lit(key)).otherwise(out)
    else:
        raise ValueError(mode)
    if hint is not None:
        h = F.lower(T.py_strip(F.col(hint) if isinstance(hint, str) else hint))
        known = F.lit([k for k, _ in outlets]) if outlets else F.array().cast("array<string>")
        out = (F.when(h.isNull() | (h == ""), out)
               .when(F.array_contains(known, h), h)
               .otherwise(F.lit(None).cast("string")))
    return out


def route_table(urls: DataFrame, registry: DataFrame, url: str = "url", mode: str = "first", col: str = "outlet_key") -> DataFrame:
    """``urls`` with the outlet key from a registry table (key, ord, domain) of any size; null = generic.

    The same rules as :func:`route`, by equi-joins on the distinct hosts: for ``longest`` a host's
    label suffixes meet the domains; for ``first`` (substring) its pieces of the lengths that
    domains have.  A host is short, so its pieces are few hundred however long the registry is.  The
    chosen key goes back to the URLs by the host, one row for each host.  Blank domains match nothing.
    """
    host = T.url_host(F.col(url), lower=True)
    named = urls.withColumn("_host", host)
    hosts = named.select("_host").where("_host <> ''").distinct()
    reg = registry.where(F.coalesce(F.col("domain"), F.lit("")) != "").groupBy("domain").agg(
        F.min(F.struct("ord", "key")).alias("_r")).select("domain", "_r.ord", "_r.key")
    if mode == "longest":
        labels = F.split("_host", r"\.")
        pieces = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
        rank = F.struct((-F.length("domain")).alias("l"), F.col("ord"), F.col("key"))
    elif mode == "first":
        # host names are bounded (255), and with them the lengths of domains that can stand in one
        lengths = sorted(r[0] for r in reg.select(F.length("domain")).distinct().where(F.length("domain") <= 255).collect())
        cut = lambda n: F.when(F.length("_host") >= n, F.transform(
            F.sequence(F.lit(1), F.greatest(F.length("_host") - n + 1, F.lit(1))), lambda i: F.substring(F.col("_host"), i, F.lit(n)))
        ).otherwise(F.array().cast("array<string>"))
        pieces = F.flatten(F.array(*[cut(n) for n in lengths])) if lengths else F.array().cast("array<string>")
        rank = F.struct("ord", "key")
    else:
        raise ValueError(mode)
    found = hosts.select("_host", F.explode(F.array_distinct(pieces)).alias("domain")).join(reg, "domain")
    best = found.groupBy("_host").agg(F.min_by("key", rank).alias(col))
    return named.join(best, "_host", "left").drop("_host")
