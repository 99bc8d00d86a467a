"""Trees that name their own branches: folder listings, and files that include files, by recursive common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolyte.functions import strings
from cartolyte.sources.shared import written
from cartolyte.sources.tables import lines


def _unbounded(df: DataFrame) -> None:
    """Lift the session's bound on a recursion's rows, unless somebody chose a number: trails end on their own."""
    name, conf = "spark.sql.cteRecursionRowLimit", df.sparkSession.conf
    if conf.get(name) == "1000000":
        conf.set(name, "-1")


def listed(listings: DataFrame, root: str = "") -> DataFrame:
    """(path, depth, is_folder): all that is below a root, each path once, by listings (folder, line).

    A line ``*name`` names a folder, another a file of the folder. Names without characters are left out; a folder that
    lies in itself is not gone into again. A folder without a listing has nothing below it.
    """
    _unbounded(listings)
    name = F.trim(F.regexp_replace("line", r"^\*", ""), F.lit("/"))
    rows = listings.select("folder", name.alias("name"), F.startswith("line", F.lit("*")).alias("is_folder")).where("name <> ''").distinct()
    found = listings.sparkSession.sql(
        """
        WITH RECURSIVE tree (path, depth, is_folder, trail) AS (
          SELECT {root}, 0, true, array({root})
          UNION ALL
          SELECT concat_ws('/', nullif(t.path, ''), r.name), t.depth + 1, r.is_folder, array_append(t.trail, concat_ws('/', nullif(t.path, ''), r.name))
          FROM tree t JOIN {rows} r ON t.path = r.folder
          WHERE t.is_folder AND NOT array_contains(t.trail, concat_ws('/', nullif(t.path, ''), r.name)))
        SELECT path, depth, is_folder FROM tree WHERE depth > 0""",
        rows=written(rows, "listing"),
        root=root,
    )
    return found.groupBy("path").agg(F.min("depth").alias("depth"), F.max("is_folder").alias("is_folder"))


def expand_nested(files: DataFrame, roots: Column, base: str = "def") -> DataFrame:
    """(path, at, source, line): the lines of the files that meet a condition, with each ``@include`` replaced by the lines of the file that it names, and so on.

    ``path`` is the file that all began with, ``source`` the one that a line is from, ``at`` the numbers of the lines
    that lead to it: in their order, the lines read as one text. An include of a missing file stays as a line, one of a
    file that includes this one, or of itself, goes.
    """
    _unbounded(files)
    text = lines(files)
    named = F.when(F.startswith(F.ltrim("line"), F.lit("@include")), strings.combine_path(F.lit(base), strings.quoted(F.col("line"))))
    known = files.select(F.col("path").alias("target")).distinct()
    edges = written(text.select("path", "line_no", named.alias("target")).where("target IS NOT NULL").join(known, "target", "left_semi"), "includes")
    tree = files.sparkSession.sql(
        """
        WITH RECURSIVE tree (path, source, at, trail) AS (
          SELECT path, path, array_remove(array(0), 0), array(path) FROM {roots}
          UNION ALL
          SELECT t.path, e.target, array_append(t.at, e.line_no), array_append(t.trail, e.target)
          FROM tree t JOIN {edges} e ON t.source = e.path WHERE NOT array_contains(t.trail, e.target))
        SELECT path, source, at FROM tree""",
        roots=files.where(roots).select("path").distinct(),
        edges=edges,
    )
    own = text.join(edges.select("path", "line_no"), ["path", "line_no"], "left_anti").withColumnRenamed("path", "source")
    return tree.join(own, "source").select("path", F.concat("at", F.array("line_no")).alias("at"), "source", "line")
