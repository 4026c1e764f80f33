"""Names, keys and paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliowright.functions.text import strip

# Words that stay small inside a title, characters no file name may hold.
SMALL_WORDS = ("a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "nor", "of", "on", "or", "the", "to", "with")
ILLEGAL = r'[<>:"/\\|?*\x00-\x1f]'
MAX_STEM = 150
NO_PROFILE = " — no profile yet"
UNIVERSAL = "Universal"


def is_pdf(path: Column) -> Column:
    return F.endswith(F.lower(path), F.lit(".pdf"))


def natural_key(path: Column) -> Column:
    """Sorts as people do: case ignored, numbers by value, a folder's own files before its subfolders.

    The key of each level is its name with digit runs padded to 20 places, longer ones behind their length; files are
    marked before folders.
    """

    def number(r: Column) -> Column:
        d = F.regexp_replace(r, r"^0+(?=\d)", "")
        return F.when(F.length(d) <= 20, F.lpad(d, 20, "0")).otherwise(F.concat(F.lit(":"), F.lpad(F.length(d).cast("string"), 9, "0"), d))

    def level(name: Column, i: Column, n: Column) -> Column:
        runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
        padded = F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), number(r)).otherwise(r))
        return F.concat(F.when(i + 1 == n, F.lit("0")).otherwise(F.lit("1")), F.array_join(padded, ""))

    parts = F.split(path, "/", -1)
    return F.array_join(F.transform(parts, lambda x, i: level(x, i, F.size(parts))), "\u0001")


def norm_key(name: Column) -> Column:
    return F.lower(strip(F.regexp_replace(name, r"(?U)[\s_\-]+", " ")))


def kebab(name: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(name), F.lit("([a-z0-9]+)"), F.lit(1)), "-")


def _words(name: Column) -> Column:
    return F.filter(F.split(name, r"(?U)[\s_\-]+", -1), lambda w: w != "")


def display_name(filename: Column) -> Column:
    """A title from an index file's name: words capitalised, small ones only in first place."""
    stem = F.regexp_replace(F.regexp_replace(filename, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")

    def word(w: Column, i: Column) -> Column:
        low = F.lower(w)
        return F.when((i > 0) & low.isin(*SMALL_WORDS), low).otherwise(F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 30)))

    return F.array_join(F.transform(_words(stem), word), " ")


def index_filename(name: Column) -> Column:
    key = norm_key(F.coalesce(name, F.lit("")))
    return F.when(key == "", "").otherwise(F.concat(F.replace(key, F.lit(" "), F.lit("-")), F.lit(".txt")))


def markdown_filename(name: Column) -> Column:
    words = F.transform(_words(strip(name)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
    return F.concat(F.array_join(words, "-"), F.lit(".md"))


def clean_novel(display: Column) -> Column:
    return F.regexp_replace(display, NO_PROFILE + "$", "")


def basename(path: Column) -> Column:
    return F.regexp_replace(path, r"(?s)^.*/", "")


def sanitize(name: Column) -> Column:
    """A file-system safe stem."""
    x = F.regexp_replace(F.regexp_replace(basename(name), ILLEGAL, "_"), r"^[ .]+|[ .]+$", "")
    x = F.regexp_replace(F.substring(x, 1, MAX_STEM), r"[ .]+$", "")
    return F.when(x == "", "untitled").otherwise(x)


def stem(name: Column) -> Column:
    return F.regexp_replace(sanitize(name), r"(?i)\.pdf$", "")


def debug_path(path: Column) -> Column:
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    s = F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")
    return F.concat(folder, F.when(F.startswith(s, F.lit("DEBUG_")), s).otherwise(F.concat(F.lit("DEBUG_"), s)), F.lit(".txt"))


def mirrored(path: Column, root: str, output_dir: Column) -> Column:
    """The output folder of an input: below the root its own subfolders, under the root's name; outside it, flat."""
    top = root.rstrip("/")
    name = top.rsplit("/", 1)[-1]
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    below = F.substring(folder, len(top) + 1, 1 << 30)
    inside = (folder == top) | F.startswith(folder, F.lit(top + "/"))
    return F.when(inside, F.concat(output_dir, F.lit("/" + name), below)).otherwise(output_dir)


def unique_paths(df: DataFrame, folder: str, name: str, order: list[str], taken: DataFrame | None = None, block: Column | None = None) -> DataFrame:
    """Add ``output_path``: the first of a stem keeps it, others get _2, _3 ... in order.

    A stem that a third of all rows share would be ranked in one task; with ``block``, a column that never falls along the
    order, rows are ranked within their block and moved on by what the blocks before hold.

    Numbers that ``taken`` (output_path) or another row's own stem already uses are passed over: free numbers
    and waiting rows are ranked and joined rank to rank, so no row waits for another.
    """
    rows = df.withColumn("_stem", stem(F.col(name)))
    key = ["_folder", "_key"]
    rows = rows.withColumn("_folder", F.col(folder)).withColumn("_key", F.col("_stem"))
    if block is None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    else:
        rows = rows.withColumn("_block", block)
        held = rows.groupBy(*key, "_block").agg(F.count("*").alias("_size"))
        before = F.sum("_size").over(Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))  # as many rows as a stem has blocks
        held = held.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_size")
        local = F.row_number().over(Window.partitionBy(*key, "_block").orderBy(*order))
        rows = rows.withColumn("_n", local).join(held, [*key, "_block"]).withColumn("_n", (F.col("_n") + F.col("_before")).cast("int")).drop("_block", "_before")
    path = lambda k: F.concat("_folder", F.lit("/"), "_stem", F.when(k > 1, F.concat(F.lit("_"), k.cast("string"))).otherwise(""), F.lit(".pdf"))
    used = rows.select("_folder", F.col("_stem").alias("_name")).distinct()
    if taken is not None:
        old = taken.select(F.regexp_extract("output_path", r"(?s)^(.*)/", 1).alias("_folder"), F.regexp_replace(F.regexp_extract("output_path", r"(?s)([^/]*)$", 1), r"\.pdf$", "").alias("_name"))
        used = used.unionByName(old).distinct()
    # numbers of "stem_k" in use
    busy = used.select("_folder", F.regexp_extract("_name", r"^(.*)_(\d{1,9})$", 1).alias("_key"), F.regexp_extract("_name", r"^(.*)_(\d{1,9})$", 2).alias("k")).where("k <> '' and k not like '0%'").select("_folder", "_key", F.col("k").cast("int").alias("k")).where("k >= 2")
    if taken is not None:
        busy = busy.unionByName(old.select("_folder", F.col("_name").alias("_key"), F.lit(1).alias("k"))).distinct()
    blocked = busy.groupBy("_folder", "_key").agg(F.sort_array(F.collect_set("k")).alias("_busy"))
    rows = rows.join(blocked, key, "left")
    # the n-th free number: n plus the busy ones not above it
    free = F.aggregate(F.coalesce("_busy", F.array().cast("array<int>")), F.col("_n"), lambda acc, b: F.when(b <= acc, acc + 1).otherwise(acc))
    return rows.withColumn("output_path", path(free)).drop("_stem", "_folder", "_key", "_n", "_busy")


def next_numbers(existing: DataFrame, name: str) -> DataFrame:
    """(base, next_number) of all folders: the next free number of those called ``base-N``, 1 where none has one."""
    base, n = F.regexp_replace(name, r"-\d{1,18}$", ""), F.regexp_extract(name, r"-(\d{1,18})$", 1)
    return existing.groupBy(base.alias("base")).agg((F.coalesce(F.max(F.when(n != "", n.cast("bigint"))), F.lit(0).cast("bigint")) + 1).alias("next_number"))


def next_number(existing: DataFrame, name: str, base: str) -> DataFrame:
    """One row: the next free number of folders called ``base-N``."""
    pattern = "(?i)^" + "".join("\\" + c if not c.isalnum() else c for c in base) + r"-(\d{1,18})$"
    n = F.regexp_extract(F.col(name), pattern, 1)
    return existing.agg((F.coalesce(F.max(F.when(n != "", n.cast("bigint"))), F.lit(0).cast("bigint")) + 1).alias("next_number"))
