"""Dependency roll-ups, roles, central modules and layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths, scores
from ..functions.names import first_of
from ..sources import work

#: Tasks that count pairs, for each that holds uses.
PAIRS = 2
LAYERS = ("model", "view", "controller", "service", "repository", "data", "ui", "core")


def roll_up(uses: DataFrame, module: str, file: str) -> DataFrame:
    """module, import_count, file_count: counted per file first, so that a module that all files use stays cheap."""
    per = uses.groupBy(module, file).agg(F.count("*").alias("n"))
    return per.groupBy(module).agg(F.sum("n").alias("import_count"), F.count("*").alias("file_count"))


def symbol_counts(uses: DataFrame, module: str, symbol: str) -> DataFrame:
    return uses.groupBy(module, symbol).agg(F.count("*").alias("n")).groupBy(module).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(symbol, "n")))).alias("symbols"))


def confidence(uses: DataFrame, module: str, order: str, value: str) -> DataFrame:
    """The running mean-of-two over each module's uses, in a stated order (an order-dependent fold).

    A use counts half of the one after it, so those before a module's last 64 are below the precision of a double; the rank
    limit keeps 64 uses a module in every task before the shuffle.
    """
    last = F.row_number().over(Window.partitionBy(module).orderBy(F.desc(order), F.desc(value)))
    uses = uses.select(module, order, value).withColumn("__last", last).where("__last <= 64")
    return uses.groupBy(module).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("u")).select(module, F.round(scores.running_confidence(F.transform("u", lambda x: x[value])), 6).alias("confidence"))


def dependency_type(module: Column, top_directories: tuple[str, ...], packages: tuple[str, ...]) -> Column:
    simple = (F.length(module) < 10) & ~module.rlike(r"[-@/]")
    return first_of([(module.startswith("."), "local_file"), (F.substring_index(module, "/", 1).isin(*top_directories), "internal"), (paths.package(module).isin(*packages), "external"), (simple, "standard_library")], "external")


def declared_packages(files: DataFrame) -> DataFrame:
    """path, package, version: each entry of each package.json."""
    named = F.from_json("content", F.lit("struct<dependencies:map<string,string>,devDependencies:map<string,string>>"))
    entries = lambda part: F.coalesce(F.map_entries(named[part]), F.array().cast("array<struct<key:string,value:string>>"))
    found = files.where("name = 'package.json'").select("path", F.explode(F.concat(entries("dependencies"), entries("devDependencies"))).alias("e"))
    return found.select("path", F.col("e.key").alias("package"), F.col("e.value").alias("version"))


def least_versions(packages: DataFrame) -> DataFrame:
    """package, version; of several versions the least."""
    return packages.groupBy("package").agg(F.min("version").alias("version"))


def manifest(files: DataFrame) -> DataFrame:
    """package, version that the package.json files name."""
    return least_versions(declared_packages(files))


def typed(rolled: DataFrame, files: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """rolled with type, version and confidence: by the tree's top directories and its manifests (packages, where they are known), both joined."""
    top = files.where(F.contains("path", F.lit("/"))).select(F.substring_index("path", "/", 1).alias("__top")).distinct().withColumn("__inside", F.lit(True))
    named = (manifest(files) if packages is None else packages).withColumnRenamed("package", "__package")
    own = rolled.withColumns({"__top": F.substring_index("module", "/", 1), "__package": paths.package(F.col("module"))})
    own = own.join(top, "__top", "left").join(named, "__package", "left")
    simple = (F.length("module") < 10) & ~F.col("module").rlike(r"[-@/]")
    kind = first_of([(F.col("module").startswith("."), "local_file"), (F.col("__inside").isNotNull(), "internal"), (F.col("version").isNotNull(), "external"), (simple, "standard_library")], "external")
    return own.withColumns({"type": kind, "confidence": F.when(F.col("version").isNotNull(), 0.9).otherwise(0.8)}).drop("__top", "__package", "__inside")


def recategorised(rolled: DataFrame, top_directories: tuple[str, ...]) -> DataFrame:
    """Types again, against the mean and greatest import count."""
    whole = rolled.agg(F.avg("import_count").alias("mean"), F.max("import_count").alias("most"))
    found = rolled.crossJoin(F.broadcast(whole))  # one row
    kind = first_of([(F.substring_index("module", "/", 1).isin(*top_directories) & (F.col("import_count") > F.col("mean")), "internal"), ((F.col("import_count") > 0.7 * F.col("most")) & ~F.contains("module", F.lit("/")), "core")], F.col("type"))
    return found.withColumn("type", kind).drop("mean", "most")


def role(imports: Column, exports: Column) -> Column:
    ratio = imports / F.when(exports > 0, exports)
    return first_of([((exports > 0) & (imports == 0), "provider"), ((exports > 0) & (imports > 0) & (ratio < 2), "adapter"), ((imports > 3) & (exports == 0), "consumer"), ((exports > 0) & (imports > 0) & (ratio >= 2), "integrator")], "unknown")


def profiles(imports: DataFrame, exports: DataFrame, file: str) -> DataFrame:
    a, b = imports.groupBy(file).agg(F.count("*").alias("imports")), exports.groupBy(file).agg(F.count("*").alias("exports"))
    found = a.join(b, file, "full").select(file, F.coalesce("imports", F.lit(0)).alias("imports"), F.coalesce("exports", F.lit(0)).alias("exports"))
    return found.withColumn("role", role(F.col("imports"), F.col("exports")))


def central(rolled: DataFrame, module: str, k: int = 10) -> DataFrame:
    return rolled.orderBy(F.desc("import_count"), module).limit(k)


def co_occurrence(uses: DataFrame, file: str, module: str, least: int = 3, common: float | None = None) -> DataFrame:
    """a, b, n: modules met in the same file at least `least` times.

    A file's modules are distinct first.  `common` leaves out modules of more than that share of all files where the
    rule says so; otherwise a file with many modules makes pairs in the square of that number, which the data model
    bounds (imports of one file, lines of one order).  Tasks follow the counted uses, so what one of them counts does not grow.
    """
    tasks = work.tasks(uses)
    own = uses.select(F.col(file).alias("f"), F.col(module).alias("m")).repartition(tasks, "f").distinct()
    if common is not None:
        files = own.select("f").distinct().count()
        rare = own.groupBy("m").agg(F.count("*").alias("n")).where(F.col("n") <= common * files).select("m")
        own = own.join(rare, "m", "left_semi")
    pairs = own.select("f", F.col("m").alias("a")).join(own.select("f", F.col("m").alias("b")), "f").where("a < b").repartition(PAIRS * tasks, "a", "b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def module_groups(pairs: DataFrame, partners: int = 2, k: int = 10) -> DataFrame:
    """Modules with at least `partners` strong partners; strength is the mean count."""
    both = pairs.select("a", "b", "n").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    return both.groupBy(F.col("a").alias("module")).agg(F.count("*").alias("partners"), F.round(F.avg("n"), 6).alias("strength")).where(F.col("partners") >= partners).orderBy(F.desc("strength"), "module").limit(k)


def layer(path: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(path), "(?:^|/)(" + "|".join(LAYERS) + ")s?/", 1), F.lit(""))


def one_way_share(edges: DataFrame) -> DataFrame:
    """pairs of layers linked, and the share linked in one direction only."""
    found = edges.select(layer(F.col("source_id")).alias("x"), layer(F.col("target_id")).alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND x <> y").distinct()
    pairs = found.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("ways"))
    return pairs.agg(F.count("*").alias("pairs"), F.round(F.avg((F.col("ways") == 1).cast("double")), 6).alias("one_way"))


def without_existing(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(old.select(*keys), keys, "left_anti").unionByName(old)


def top_partners(pairs: DataFrame, k: int = 3) -> DataFrame:
    both = pairs.select("a", "b", "n").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))).where(F.col("rank") <= k)


def might_target(module: Column, target: Column) -> Column:
    """Whether a specifier may mean a file: by its stem, as a part of its path or the reverse, or by the directory that it names."""
    directory = paths.dirname(module)
    named = directory.isNotNull() & ~directory.isin("", ".") & F.startswith(target, directory)
    return (module == F.regexp_extract(target, r"([^/]+?)(\.[^./]*)?$", 1)) | F.contains(target, module) | F.contains(module, target) | named


def enriched(imports: DataFrame, edges: DataFrame) -> DataFrame:
    """path, module, resolved_path: the least target among the edges of the same file that an import may mean, null if none.

    imports: path, module; edges: source_id (a path), target_id (a path).
    """
    own = edges.select(F.col("source_id").alias("path"), "target_id").distinct()
    best = imports.join(own, "path").where(might_target(F.col("module"), F.col("target_id"))).groupBy("path", "module").agg(F.min("target_id").alias("resolved_path"))
    return imports.join(best, ["path", "module"], "left").select("path", "module", "resolved_path")


def architecture(rolled: DataFrame, groups: DataFrame, links: DataFrame) -> DataFrame:
    """name, n, confidence of the architectures that the dependencies show; counts only, one row each.

    A module imported more than five times makes a central one; three groups of strength above 2 a modular one; layers of which
    more than 60 % of all pairs depend one way a layered one.  links: source_id, target_id (paths).
    """
    most = rolled.agg(F.max("import_count").alias("n")).where("n > 5").select(F.lit("central").alias("name"), F.col("n").cast("long"), (0.7 + F.least(F.lit(0.2), F.col("n") / 50)).alias("confidence"))
    strong = groups.where("strength > 2").agg(F.count("*").alias("n")).where("n >= 3").select(F.lit("modular").alias("name"), "n", (0.7 + F.least(F.lit(0.2), F.col("n") / 10)).alias("confidence"))
    ends = links.select(layer(F.col("source_id")).alias("x"), layer(F.col("target_id")).alias("y")).distinct()
    layers = ends.select(F.explode(F.array("x", "y")).alias("l")).where("l IS NOT NULL").agg(F.countDistinct("l").alias("layers"))
    ways = ends.where("x IS NOT NULL AND y IS NOT NULL AND x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("ways"))
    one_way = ways.agg(F.count_if(F.col("ways") == 1).alias("n")).crossJoin(layers).where("n > 0.6 * layers * (layers - 1) / 2").select(F.lit("layered").alias("name"), "n", F.lit(0.75).alias("confidence"))  # one row each
    return most.unionByName(strong).unionByName(one_way).withColumn("confidence", F.round("confidence", 6))
