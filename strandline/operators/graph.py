"""Symbol table and call edges from extracted declarations and call references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import names


def last_wins(declared: DataFrame) -> DataFrame:
    """One symbol for each qualified name: the last one, by path and then by `pos` in it."""
    order = Window.partitionBy("name").orderBy(F.col("path").desc(), F.col("pos").desc())
    return declared.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "pos")


def callable_index(symbols: DataFrame) -> DataFrame:
    """(key, name): each symbol under its name without the first segment and under its last segment."""
    keys = F.array_distinct(F.array(names.callable_name(F.col("name")), names.short_name(F.col("name"))))
    return symbols.select(F.explode(keys).alias("key"), "name").where("key <> ''")


def _latest(refs: DataFrame, *keys: str) -> DataFrame:
    """One reference for each key: edges keep their last call site, so earlier ones need not be resolved."""
    site = F.struct("site_path", "site_line", "site_code")
    order = F.struct("path", "seq")
    return refs.groupBy(*keys).agg(F.max_by(site, order).alias("site"), F.max(order).alias("order"))


def resolve_go(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, site, order): the target in the caller's package, else as it stands, else every symbol that is called so."""
    calls = _latest(refs, "src", "target", "package")
    known = symbols.select("name")
    in_package = known.select(F.col("name").alias("in_package"))
    as_is = known.select(F.col("name").alias("as_is"))
    found = calls.join(in_package, F.concat("package", F.lit("."), "target") == F.col("in_package"), "left")
    found = found.join(as_is, F.col("target") == F.col("as_is"), "left")
    found = found.withColumn("dst", F.coalesce("in_package", "as_is"))
    exact = found.where("dst is not null").select("src", "dst", "site", "order")
    index = callable_index(symbols).withColumnRenamed("name", "dst")
    bare = found.where("dst is null").drop("dst").join(index, F.col("target") == F.col("key"))
    return exact.unionByName(bare.select("src", "dst", "site", "order"))


def java_imports(sources: DataFrame) -> DataFrame:
    """(path, is_static, is_wildcard, owner, short, ord) of import lines, by pattern on the raw source."""
    pattern = r"(?m)^\s*import\s+(static\s+)?([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*(?:\.\*)?)\s*;"
    found = sources.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("ord", "line"))
    name = F.regexp_extract("line", pattern, 2)
    return imports(found.select("path", "ord", (F.regexp_extract("line", pattern, 1) != "").alias("is_static"), name.alias("name")))


def imports(rows: DataFrame) -> DataFrame:
    """The same from (path, ord, is_static, name), where a name may end in a star."""
    wild = F.col("name").endswith(".*")
    rows = rows.where(F.col("name").contains("."))
    return rows.select(
        "path", "is_static", wild.alias("is_wildcard"), F.regexp_replace("name", r"\.[^.]*$", "").alias("owner"),
        F.when(~wild, names.short_name(F.col("name"))).alias("short"), "ord",
    )


def resolve_java(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(src, dst, site, order): the first hit of a cascade of candidate names, each with a priority and an ordinal."""
    calls = _latest(refs, "src", "target", "package", "path").withColumn("call", F.struct("src", "target", "package", "path"))
    calls = calls.withColumn("dotted", F.col("target").contains("."))
    calls = calls.withColumn("receiver", F.when(F.col("dotted"), F.regexp_replace("target", r"\.[^.]*$", "")))
    calls = calls.withColumn("method", names.short_name(F.col("target")))
    owner = F.when(F.col("src").contains("."), F.element_at(F.split("src", r"\."), -2)).otherwise("")
    own_static = ~F.col("dotted") | (F.col("receiver") == owner)
    types = symbols.where(F.col("kind").isin(names.JAVA_TYPE_KINDS)).select(F.col("name").alias("type"))
    keys = ["call", "src", "path", "package", "target", "receiver", "method"]

    def candidate(rows: DataFrame, priority, ordinal, name) -> DataFrame:
        return rows.select("call", F.lit(priority).alias("priority"), ordinal.cast("int").alias("ordinal"), name.alias("name"))

    joined = F.concat_ws(".", F.col("package"), F.col("target"))
    out = candidate(calls, 0, F.lit(0), joined).unionByName(candidate(calls, 1, F.lit(0), F.col("target")))
    # The receiver's type: named in full, imported, of the same package, or of wildcard imports in their order.
    typed = calls.where("dotted").select(*keys)
    full = typed.where(F.col("receiver").contains("."))
    simple = typed.where(~F.col("receiver").contains("."))
    single = imports.where("not is_static and not is_wildcard").groupBy("path", "short").agg(F.max_by("owner", "ord").alias("owner"))
    wild = imports.where("not is_static and is_wildcard").select("path", "owner", "ord")
    guesses = (
        full.select("call", "method", F.lit(0).alias("step"), F.lit(0).alias("ord"), F.col("receiver").alias("type"))
        .unionByName(full.select("call", "method", F.lit(1).alias("step"), F.lit(0).alias("ord"), F.concat_ws(".", "package", "receiver").alias("type")))
        .unionByName(
            simple.join(single, (simple["path"] == single["path"]) & (simple["receiver"] == single["short"]))
            .select("call", "method", F.lit(0).alias("step"), F.lit(0).alias("ord"), F.concat_ws(".", "owner", "receiver").alias("type"))
        )
        .unionByName(simple.select("call", "method", F.lit(1).alias("step"), F.lit(0).alias("ord"), F.concat_ws(".", "package", "receiver").alias("type")))
        .unionByName(
            simple.join(wild, "path").select("call", "method", F.lit(2).alias("step"), "ord", F.concat_ws(".", "owner", "receiver").alias("type"))
        )
    )
    real = guesses.join(types, "type", "left_semi")
    real = real.withColumn("best", F.min("step").over(Window.partitionBy("call"))).where("step = best")
    out = out.unionByName(candidate(real, 2, F.col("ord"), F.concat_ws(".", "type", "method")))
    # Static imports of the method, then static wildcard imports.
    static = calls.where(own_static).select("call", "path", "method")
    named = imports.where("is_static and not is_wildcard").select("path", "owner", F.col("short").alias("method"), "ord")
    starred = imports.where("is_static and is_wildcard").select("path", "owner", "ord")
    out = out.unionByName(candidate(static.join(named, ["path", "method"]), 3, F.col("ord"), F.concat_ws(".", "owner", "method")))
    out = out.unionByName(candidate(static.join(starred, "path"), 4, F.col("ord"), F.concat_ws(".", "owner", "method")))
    hits = out.join(symbols.select("name"), "name", "left_semi")
    first = hits.groupBy("call").agg(F.min_by("name", F.struct("priority", "ordinal")).alias("dst"))
    return calls.join(first, "call").select("src", "dst", "site", "order")


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct (src, dst) without self-calls, each with its last call site."""
    kept = resolved.where("src <> dst").groupBy("src", "dst").agg(F.max_by("site", "order").alias("site"))
    return kept.select("src", "dst", "site.*")


def call_graph(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    go = resolve_go(refs.where("language = 'go'"), symbols)
    java = resolve_java(refs.where("language = 'java'"), symbols, imports)
    return edges(go.unionByName(java))
