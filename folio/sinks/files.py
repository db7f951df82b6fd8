"""What a run leaves behind as files: requests, results, errors, lists. Writers are Spark's, so each task writes its own
part; nothing passes through the driver."""

from __future__ import annotations

from itertools import count
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import WRAPPED, wrap_document


def free_path(spark: SparkSession, path: str) -> str:
    """`path`, or the first of path_1, path_2 and so on that isn't taken."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    taken = lambda p: jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))
    base, n = path.rstrip("/"), 0
    while taken(out := base if n == 0 else f"{base}_{n}"):
        n += 1
    return out


def claimed_path(spark: SparkSession, path: str) -> str:
    """A new folder: `path`, or the first of path_1, path_2 and so on that nobody has. Making it claims it, so of several
    that ask at once each gets its own. Folders of the user's own (the root, the home, the working folder, what is above
    them, a repository's .git) are refused."""
    base = path.rstrip("/") or "/"
    local = _local(spark, base)
    if local is not None:
        _own_folder(local)
        local.parent.mkdir(parents=True, exist_ok=True)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for n in count():
        out = base if n == 0 else f"{base}_{n}"
        try:
            if local is not None:
                Path(f"{local}{out[len(base):]}").mkdir()
            else:
                mark = jvm.org.apache.hadoop.fs.Path(f"{out}/.claimed")
                where = mark.getFileSystem(conf)
                if where.exists(mark.getParent()):
                    continue
                where.create(mark, False).close()
            return out
        except (FileExistsError, Py4JJavaError) as e:
            if isinstance(e, Py4JJavaError) and "AlreadyExists" not in str(e.java_exception):
                raise
    raise AssertionError


def _local(spark: SparkSession, path: str) -> Path | None:
    """The path on this machine, or None where it is elsewhere."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    where = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return Path(where.makeQualified(at).toUri().getPath()) if where.getScheme() == "file" else None


def _own_folder(target: Path) -> None:
    at = target.parent.resolve() / target.name
    kept = {Path("/"), *(q for p in (Path.home(), Path.cwd()) for q in (p.resolve(), *p.resolve().parents))}
    if at in kept or ".git" in at.parts:
        raise ValueError(f"{target} isn't a folder for output")


def is_plain_name(stem: Column) -> Column:
    """Whether a name stays inside the folder that it is joined to."""
    return F.coalesce(~stem.isin("", ".", "..") & ~stem.rlike(r"[/\\\x00]"), F.lit(False))


def jsonl(rows: DataFrame, path: str) -> None:
    """A JSON object a line; null fields are kept."""
    rows.write.option("ignoreNullFields", "false").json(path)


def json_arrays(rows: DataFrame, path: str, key: str = "token", order: str = "pos") -> None:
    """For each key one line with the JSON array of its rows in order, under path/key=...; a key's rows are a document's."""
    cells = F.struct(order, F.struct(*[c for c in rows.columns if c not in (key, order)]).alias("row"))
    lists = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(cells)), lambda c: c["row"]).alias("rows"))
    lists.select(key, F.to_json("rows", {"ignoreNullFields": "false"}).alias("value")).write.partitionBy(key).text(path)


def trigger_meta(jobs: DataFrame, path: str) -> None:
    """The requests: token, input_type, input, submitted_at, trigger_kwargs (any struct, or none)."""
    have = [c for c in ("token", "input_type", "input", "submitted_at", "trigger_kwargs") if c in jobs.columns]
    jobs.select(*have).write.json(path)


def parse_results(results: DataFrame, path: str) -> DataFrame:
    """token, content_chars of results (token, stem, pages_tree, content and further columns), after they are written:
    pages_tree as JSON and content as Markdown by token, and all but the content as JSON lines."""
    content = F.coalesce("content", F.lit(""))
    results.select("token", F.col("pages_tree").alias("value")).write.partitionBy("token").text(f"{path}/pages_tree")
    named = F.coalesce(F.nullif("stem", F.lit("")), F.lit("document"))
    results.select("token", named.alias("stem"), content.alias("value")).write.partitionBy("token", "stem").option("lineSep", "\n").text(f"{path}/markdown")
    results.drop("content", "pages_tree").write.json(f"{path}/formatted_meta")
    return results.select("token", F.length(content).alias("content_chars"))


def failures(results: DataFrame, error: Column, path: str) -> DataFrame:
    """The rows without an error; those with one are written with it, whole, as JSON lines."""
    marked = results.withColumn("error", error)
    marked.where("error is not null").write.json(path)
    return marked.where("error is null").drop("error")


def documents(results: DataFrame, path: str, form: str) -> None:
    """Each token's content as a whole document of a format."""
    results.select("token", wrap_document(F.col("content"), form).alias("value")).write.partitionBy("token").text(f"{path}/{WRAPPED[form][2]}")
