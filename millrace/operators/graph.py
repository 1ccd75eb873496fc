"""Import graphs of repositories: edges, closure, order, levels, merged text.

Edges are one row each, `repo, src, dst, ord`. The closure is a loop of joins whose reach doubles in each round; its lineage
is cut in every round. Order and level within one root's closure are sequential, so they run by (repo, root)
on that closure alone, which MAX_CLOSURE bounds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import code as C
from millrace.functions import text as T
from millrace.session import removed, written

MAX_CLOSURE = 200_000


def modules(files: DataFrame, repo: str, path: str, code: str) -> DataFrame:
    """repo, module, ord (order of path), path, imports of each file; one row for each (repo, module): the first path."""
    made = files.select(F.col(repo).alias("repo"), T.module_name(path).alias("module"), F.col(path).alias("path"), C.imports_column(code).alias("imports")).where("module is not null")
    first = made.groupBy("repo", "module").agg(F.min_by(F.struct("path", "imports"), F.col("path")).alias("_m"))
    return first.select("repo", "module", "_m.path", "_m.imports")


def _prefixes(c: Column, mode: str) -> Column:
    """All prefixes of a name: by characters, or by dotted parts."""
    if mode == "dotted":
        parts = F.split(c, "\\.", -1)
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, F.lit(1), i))


def meetings(mods: DataFrame, mode: str = "prefix") -> DataFrame:
    """repo, want, dst: the module that each imported name means, for names that mean one.

    A module is known by all its dotted suffixes; of modules with one suffix the first by path has it. A name means what it
    equals, or what begins with it, or what it begins with; an equal suffix comes before others, then the first by path.
    mode 'dotted': beginnings end at a point. 'prefix': they need not, so `os` means `ossify`. Beginnings are met by equality
    joins on prefixes, of which only the best module is kept: a repository of n names costs n times their length, not n * n.
    """
    names = mods.select("repo", F.col("module").alias("dst"), "path", F.explode(T.suffixes("module")).alias("name"))
    names = names.groupBy("repo", "name").agg(F.min_by("dst", "path").alias("dst"), F.min("path").alias("path"))
    wants = mods.select("repo", F.explode("imports").alias("want")).where("want <> ''").distinct()
    longer = names.select("repo", "dst", "path", "name", F.explode(_prefixes(F.col("name"), mode)).alias("want"))
    longer = longer.groupBy("repo", "want").agg(F.min(F.struct((F.col("name") != F.col("want")).cast("int").alias("other"), "path", "name", "dst")).alias("m"))
    shorter = wants.select("repo", "want", F.explode(_prefixes(F.col("want"), mode)).alias("name")).join(names, ["repo", "name"])
    shorter = shorter.groupBy("repo", "want").agg(F.min(F.struct((F.col("name") != F.col("want")).cast("int").alias("other"), "path", "name", "dst")).alias("m"))
    both = wants.join(longer, ["repo", "want"]).unionByName(shorter)
    return both.groupBy("repo", "want").agg(F.min("m").alias("m")).select("repo", "want", "m.dst")


def edges(mods: DataFrame, mode: str = "prefix") -> DataFrame:
    """repo, src, dst, ord: imports of known modules of the same repository, each once, in order; none on itself."""
    wants = mods.select("repo", F.col("module").alias("src"), F.posexplode("imports").alias("ord", "want"))
    best = wants.join(meetings(mods, mode), ["repo", "want"])
    return best.where("src <> dst").groupBy("repo", "src", "dst").agg(F.min("ord").alias("ord"))


def external(mods: DataFrame, mode: str = "prefix") -> DataFrame:
    """repo, src, package: first component of each import that means no module of the repository."""
    wants = mods.select("repo", F.col("module").alias("src"), F.explode(F.array_distinct("imports")).alias("want"))
    return wants.join(meetings(mods, mode), ["repo", "want"], "left_anti").select("repo", "src", T.package("want").alias("package")).distinct()


def closure(mods: DataFrame, links: DataFrame) -> DataFrame:
    """repo, root, module: everything reachable from each module, itself included. Cycles end by what is already known.

    Reach doubles in each round: what was found last, at distances of just over half the reach, goes on by all that is known.
    A round writes only what is new, beside what earlier rounds wrote.
    """
    known = [written(mods.select("repo", F.col("module").alias("root"), "module"), "closure")]
    step = links.select("repo", F.col("src").alias("root"), F.col("dst").alias("module")).where("root <> module").distinct()
    fresh = written(step.join(mods.select("repo", F.col("module").alias("root")).distinct(), ["repo", "root"], "left_semi"), "closure")
    while not fresh.isEmpty():
        known.append(fresh)
        every = reduce(DataFrame.unionByName, known)
        onward = every.select("repo", F.col("root").alias("module"), F.col("module").alias("next"))
        found = fresh.join(onward, ["repo", "module"]).select("repo", "root", F.col("next").alias("module")).distinct()
        fresh = written(found.join(every, ["repo", "root", "module"], "left_anti"), "closure")
    removed(fresh)
    return reduce(DataFrame.unionByName, known)


def ordered(reach: DataFrame, links: DataFrame) -> DataFrame:
    """repo, root, module, pos, level, deps: leaves first; ties and what a cycle leaves over go by name. Level 0 has no
    dependencies in the closure, else one more than the deepest that stands before it."""
    deps = links.groupBy("repo", F.col("src").alias("module")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dst"))), lambda x: x["dst"]).alias("deps"))
    rows = reach.join(deps, ["repo", "module"], "left").select("repo", "root", "module", F.coalesce("deps", F.array().cast("array<string>")).alias("deps"))

    def one(members: list[dict]) -> Iterator[tuple[str, int, int, list[str]]]:
        if len(members) > MAX_CLOSURE:
            raise ValueError(f"a closure of {len(members)} modules is beyond MAX_CLOSURE")
        inside = {x["module"] for x in members}
        deps = {x["module"]: [d for d in x["deps"] if d in inside] for x in members}
        users: dict[str, list[str]] = {}
        for m, ds in deps.items():
            for d in ds:
                users.setdefault(d, []).append(m)
        open_deps = {m: len(ds) for m, ds in deps.items()}
        ready = [(0, m) for m in deps if not open_deps[m]]
        heapq.heapify(ready)
        order: list[str] = []
        turn = 0
        while ready:
            _, m = heapq.heappop(ready)
            order.append(m)
            turn += 1
            for u in sorted(users.get(m, ())):
                open_deps[u] -= 1
                if not open_deps[u]:
                    heapq.heappush(ready, (turn, u))
        placed = set(order)
        order += sorted(m for m in deps if m not in placed)
        level: dict[str, int] = {}
        for pos, m in enumerate(order):
            level[m] = 1 + max(level.get(d, 0) for d in deps[m]) if deps[m] else 0
            yield m, pos, level[m], deps[m]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 2000) for whole in batches for i in range(0, whole.num_rows, 2000)):
            made = [(repo, root, *x) for repo, root, members in zip(*(b.column(k).to_pylist() for k in range(3))) for x in one(members)]
            columns = list(zip(*made)) if made else [[]] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["repo", "root", "module", "pos", "level", "deps"])

    # one row a root, whatever its closure: no pandas frame is made for each
    return rows.groupBy("repo", "root").agg(F.collect_list(F.struct("module", "deps"))).mapInArrow(run, "repo string, root string, module string, pos int, level int, deps array<string>")


def rendered(order: DataFrame, contents: DataFrame, shown: int = 5, deepest: int = 10) -> DataFrame:
    """repo, root, text: a head, the tree of modules by level, and each module's text, leaves first.

    contents: repo, module, content. The tree marks the root with a star and shows the first few dependencies.
    """
    pick = F.slice("deps", 1, shown)
    more = F.when(F.size("deps") > shown, F.concat(F.lit(", ... and "), (F.size("deps") - shown).cast("string"), F.lit(" more"))).otherwise("")
    row = F.concat(F.repeat(F.lit("  "), F.least("level", F.lit(deepest))), F.when(F.col("module") == F.col("root"), "★ ").otherwise("- "), "module", F.when(F.size("deps") > 0, F.concat(F.lit(" <- "), F.array_join(pick, ", "), more)).otherwise(""))
    block = F.concat(F.lit("# ===== module: "), "module", F.lit(" =====\n"), F.coalesce("content", F.lit("")))
    lines = order.join(contents, ["repo", "module"], "left").select("repo", "root", "pos", row.alias("row"), block.alias("block"))
    parts = lines.groupBy("repo", "root").agg(F.array_sort(F.collect_list(F.struct("pos", "row", "block"))).alias("p"))
    return parts.select("repo", "root", F.concat(F.lit("# merged for "), "root", F.lit("\n"), F.array_join(F.transform("p", lambda x: x["row"]), "\n"), F.lit("\n\n"), F.array_join(F.transform("p", lambda x: x["block"]), "\n\n")).alias("text"))


def repository_summary(mods: DataFrame, order: DataFrame, outside: DataFrame) -> DataFrame:
    """repo, modules, packages (sorted), text: what a repository's report says. Null-free; a repository without outside packages
    has an empty list. order: what `ordered` gives; outside: what `external` gives."""
    sizes = mods.groupBy("repo").agg(F.count("*").alias("modules"))
    deepest = order.groupBy("repo").agg(F.max("level").alias("levels"))
    packages = outside.groupBy("repo").agg(F.sort_array(F.collect_set("package")).alias("packages"))
    every = sizes.join(deepest, "repo", "left").join(packages, "repo", "left").withColumn("packages", F.coalesce("packages", F.array().cast("array<string>")))
    text = F.concat(F.lit("repository: "), "repo", F.lit("\nmodules: "), F.col("modules").cast("string"), F.lit("\ndeepest level: "), F.coalesce("levels", F.lit(0)).cast("string"), F.lit("\noutside packages: "), F.size("packages").cast("string"), F.lit("\n"), F.array_join(F.transform("packages", lambda p: F.concat(F.lit("  "), p)), "\n"))
    return every.select("repo", "modules", "packages", text.alias("text"))
