"""From commits and changes to facts: introductions, body gates, dependency diffs, renames, lineage.

Everything is one batch DAG; the answers of a forward and a reverse walk that meet are those of the
batch, so no order of arrival matters.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import ROWS_A_TASK, discard, materialize, ship_package

#: git's mode of a gitlink; shortest body that a rename is matched on, and rounds of matching.
GITLINK, MIN_BODY, MOST_ROUNDS = "160000", 20, 10
#: Keys under which a file is found, about.
KEYS_A_FILE = 8
#: Steps of a round of :func:`linearize`.
STEPS = 3


def introduced_by(touches: DataFrame) -> DataFrame:
    """``touches``: (e, pos, commit). The commit of the lowest position per entity."""
    return touches.groupBy("e").agg(F.min_by("commit", "pos").alias("introduced_by"), F.min("pos").alias("pos"))


def introduced_modified(touches: DataFrame) -> DataFrame:
    """(e, a, v): the first sighting introduces, each later commit modifies."""
    once = touches.select("e", "pos", "commit").distinct()
    first = once.groupBy("e").agg(F.min("pos").alias("first"))
    j = once.join(first, "e")
    return j.select("e", F.when(F.col("pos") == F.col("first"), ":introduced-by").otherwise(":modified-in").alias("a"), F.col("commit").alias("v"))


def body_hash(tokens: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", tokens).cast("binary"), 256)


def body_diff_gate(versions: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``modified``: the body differs from the version before; a module always counts as modified."""
    prev = F.lag("body_hash").over(Window.partitionBy("e").orderBy(*order))
    return versions.withColumn("modified", prev.isNotNull() & ((prev != F.col("body_hash")) | F.col("is_module")))


def dep_diff(sets: DataFrame, key: str, order: str, deps: str) -> DataFrame:
    """Edges that each version adds and removes against the one before."""
    before = F.coalesce(F.lag(deps).over(Window.partitionBy(key).orderBy(order)), F.array().cast("array<string>"))
    d = sets.withColumn("__before", before)
    return d.select(key, order, F.array_sort(F.array_except(deps, "__before")).alias("added"), F.array_sort(F.array_except("__before", deps)).alias("removed"))


def normalized(tokens: Column, tracked: Column) -> Column:
    """Token text with untracked identifiers replaced by the number of their first appearance."""
    ident = lambda t: t.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~F.array_contains(tracked, t)
    names = F.array_distinct(F.filter(tokens, ident))
    return F.array_join(F.transform(tokens, lambda t: F.when(ident(t), F.concat(F.lit("$"), F.array_position(names, t).cast("string"))).otherwise(t)), "\x00")


def rename_match(bodies: DataFrame) -> DataFrame:
    """``bodies``: (commit, side ``removed``/``added``, e, tokens, tracked). Pairs that are each other's only match.

    Bodies match if one maps onto the other by a one-to-one renaming of local identifiers, which equal
    normal forms say; an ambiguous form matches nothing.
    """
    b = bodies.withColumn("form", normalized(F.col("tokens"), F.col("tracked"))).filter(F.length(F.array_join("tokens", " ")) >= MIN_BODY)
    side = lambda s: F.when(F.col("side") == s, F.col("e"))
    g = b.groupBy("commit", "form").agg(F.count(side("removed")).alias("r"), F.count(side("added")).alias("a"), F.max(side("removed")).alias("renamed_from"), F.max(side("added")).alias("renamed_to"))
    return g.filter("r = 1 AND a = 1").select("commit", "renamed_from", "renamed_to")


def rename_rounds(bodies: DataFrame, names: DataFrame, most: int = MOST_ROUNDS) -> DataFrame:
    """(commit, renamed_from, renamed_to) of entities that a commit takes away under one name and brings under another.

    ``bodies`` (commit, pos, side ``removed``/``added``, e, entity_type, name, tokens); ``names`` (name, first_pos) of all entities,
    with the position from which on each is known. An identifier that names a known entity must stay, or become
    what a rename confirmed in an earlier round made of it; others may change one to one. An entity's own name is free.
    A round matches what is each other's only partner of its type; the next sees the names so found.
    """
    own = F.transform("tokens", lambda t: F.when(t == F.col("name"), F.lit("\x01")).otherwise(t))
    b = bodies.filter(F.length(F.array_join("tokens", " ")) >= MIN_BODY).withColumn("tokens", own).withColumn("id", F.struct("commit", "side", "e"))
    used = b.select("id", "pos", F.explode(F.array_distinct("tokens")).alias("name")).join(names.select("name", "first_pos"), "name").filter("first_pos <= pos")
    tracked = used.groupBy("id").agg(F.collect_set("name").alias("tracked"))
    left = materialize(b.join(tracked, "id", "left").select("commit", "side", "e", "entity_type", "name", "tokens", F.coalesce("tracked", F.array().cast("array<string>")).alias("tracked")), "bodies")
    found = None
    for _ in range(most):
        now = left
        if found is not None:
            one = found.groupBy("commit", "old").agg(F.count_distinct("new").alias("n"), F.min("new").alias("new")).filter("n = 1")
            maps = one.groupBy("commit").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("to"))
            moved = lambda c: F.transform(c, lambda t: F.coalesce(F.try_element_at("to", t), t))
            gone = F.col("side") == "removed"
            now = left.join(maps, "commit", "left").withColumn("to", F.coalesce("to", F.create_map().cast("map<string,string>")))
            now = now.withColumns({"tokens": F.when(gone, moved("tokens")).otherwise(F.col("tokens")), "tracked": F.when(gone, moved("tracked")).otherwise(F.col("tracked"))})
        form = now.withColumn("form", normalized(F.col("tokens"), F.col("tracked")))
        side = lambda s: F.when(F.col("side") == s, F.struct("e", "name"))
        g = form.groupBy("commit", "entity_type", "form").agg(F.count(side("removed")).alias("r"), F.count(side("added")).alias("a"), F.max(side("removed")).alias("x"), F.max(side("added")).alias("y"))
        new = materialize(g.filter("r = 1 AND a = 1").select("commit", F.col("x.e").alias("renamed_from"), F.col("y.e").alias("renamed_to"), F.col("x.name").alias("old"), F.col("y.name").alias("new")), "renames")
        if not new.take(1):
            break
        found = new if found is None else found.unionByName(new)
        taken = new.select("commit", F.explode(F.array("renamed_from", "renamed_to")).alias("e"))
        left = materialize(left.join(taken, ["commit", "e"], "left_anti"), "bodies")
    if found is None:
        return bodies.select("commit", F.col("e").alias("renamed_from"), F.col("e").alias("renamed_to")).limit(0)
    return found.select("commit", "renamed_from", "renamed_to")


def chain_ends(steps: DataFrame) -> DataFrame:
    """``steps``: (src, dst), at most one a source. (src, last, hops) by pointer doubling: a round makes paths four times as long."""
    at = materialize(steps.select("src", F.col("dst").alias("last"), F.lit(1).cast("long").alias("hops")), "chain")
    n = at.count()
    for _ in range(max(2, n.bit_length() // 2 + 2)):
        nxt = at.withColumn("moved", F.lit(False))
        for _ in range(2):
            a, b = nxt.alias("a"), nxt.alias("b")
            j = a.join(b, F.col("a.last") == F.col("b.src"), "left")
            nxt = j.select("a.src", F.coalesce("b.last", "a.last").alias("last"), (F.col("a.hops") + F.coalesce("b.hops", F.lit(0))).alias("hops"), (F.col("a.moved") | F.col("b.src").isNotNull()).alias("moved"))
        nxt = materialize(nxt, "chain")
        more = nxt.filter("moved").take(1)
        discard(at)
        at = nxt.select("src", "last", "hops")
        if not more:
            return at
    raise ValueError("a chain runs in a circle")


def gitlink_action(old_mode: Column, new_mode: Column) -> Column:
    """What a raw diff line does to an external dependency; null for plain files."""
    was, now = old_mode == GITLINK, new_mode == GITLINK
    return F.when(now & ~was, "open").when(now & was, "repin").when(was & ~now, "close")


def lineage_trusted(introductions: DataFrame, markers: DataFrame, confirmed_through: int) -> DataFrame:
    """Entities whose introduction is final: no provisional marker, and at or below the confirmed position."""
    return introductions.filter(F.col("pos") <= confirmed_through).join(markers.select("e").distinct(), "e", "left_anti")


def sweep_actions(touched: DataFrame, live: DataFrame, markers: DataFrame) -> DataFrame:
    """What the correction sweep does for each (e, commit) touched.

    ``touched``: (e, commit, body_changed, has_modified); ``live``: (e, v) live ``:introduced-by``; ``markers``: (e).
    """
    values = live.groupBy("e").agg(F.count_distinct("v").alias("n"), F.min("v").alias("only"))
    marked = markers.select("e").distinct().withColumn("provisional", F.lit(True))
    j = touched.join(values, "e", "left").join(marked, "e", "left")
    own = (F.col("n") == 1) & (F.col("only") == F.col("commit"))
    action = (
        F.when(F.col("provisional") & own, "confirm")
        .when(F.col("provisional"), "skip_provisional")
        .when(F.coalesce(F.col("n"), F.lit(0)) != 1, "skip_ambiguous")
        .when(own, "skip_own")
        .when(~F.col("body_changed") & F.col("has_modified"), "retract_modified")
        .when(F.col("body_changed") & ~F.col("has_modified"), "assert_modified")
        .otherwise("keep")
    )
    return j.select("e", "commit", action.alias("action"))


def interleave(total: DataFrame, key: str, forward: int, reverse: int) -> DataFrame:
    """(key, step, stream, pos): which position each step of two converging streams claims, in closed form."""
    steps = total.select(key, "total_positions", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_positions") - 1)).alias("step")).filter("total_positions > 0")
    cycle = forward + reverse
    i, turn = F.floor(F.col("step") / cycle), F.col("step") % cycle
    ahead = i * forward + F.least(turn, F.lit(forward))
    fwd = turn < forward
    return steps.select(key, "step", F.when(fwd, "forward").otherwise("reverse").alias("stream"), F.when(fwd, ahead).otherwise(F.col("total_positions") - 1 - (F.col("step") - ahead)).alias("pos"))


def _suffixes(c: Column) -> Column:
    parts = F.split(c, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def import_index(files: DataFrame) -> DataFrame:
    """``files`` (path, …): (key, exact, rank, path, …) of every name under which an import may find a file.

    Relative names meet whole stems (``exact`` 0). Others meet, by rank: source roots, ``*/name/mod.rs``, a path without
    extension that ends in the name's segments, then a directory that does.
    """
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    roots = F.array_compact(F.array(*[F.when(F.col("path").rlike(f"^{r}[^/]+\\.rs$"), F.regexp_extract("path", f"^{r}([^/]+)\\.rs$", 1)) for r in ("src/", "lib/", "")]))
    none = F.array().cast("array<string>")
    named = lambda keys, rank, ok=None: F.transform(keys if ok is None else F.when(ok, keys).otherwise(none), lambda k: F.struct(k.alias("key"), F.lit(rank).alias("rank")))
    keys = F.concat(
        named(F.array(stem), 0),
        named(roots, 1),
        named(F.array(F.regexp_extract("path", r"([^/]+)/mod\.rs$", 1)), 2, F.col("path").rlike(r"/mod\.rs$")),
        named(_suffixes(stem), 3),
        named(_suffixes(parent), 4, parent != ""),
    )
    # a file has a key for each part of its path, so tasks that hold many short paths make many times their rows
    dealt = files.repartition(max(1, -(-files.count() * KEYS_A_FILE // ROWS_A_TASK)), "path")
    rows = dealt.select(*files.columns, F.explode(keys).alias("k"))
    return rows.select("k.key", F.when(F.col("k.rank") == 0, 0).otherwise(1).alias("exact"), "k.rank", *files.columns)


def import_keys(imports: DataFrame) -> DataFrame:
    """``imports`` (importing_file, name, …) with the ``key`` and kind of look-up (``exact``) of each."""
    own_dir = F.regexp_extract("importing_file", "^(.*)/[^/]*$", 1)
    dots = F.length(F.regexp_extract("name", r"^\.+", 0))
    slash = F.col("name").rlike(r"^\.\.?/")
    ups = F.when(slash, F.size(F.regexp_extract_all("name", F.lit(r"\.\./"), F.lit(0)))).otherwise(dots - 1)
    base = F.array_join(F.slice(F.split(own_dir, "/"), 1, F.greatest(F.size(F.split(own_dir, "/")) - ups, F.lit(0))), "/")
    rest = F.when(slash, F.regexp_replace("name", r"^(\.\.?/)+", "")).otherwise(F.replace(F.regexp_replace("name", r"^\.+", ""), F.lit("."), F.lit("/")))
    relative = F.col("name").startswith(".")
    target = F.array_join(F.filter(F.array(base, rest), lambda x: x != ""), "/")
    plain = F.when(F.col("name").contains("/"), F.col("name")).otherwise(F.replace(F.col("name"), F.lit("."), F.lit("/")))
    return imports.select(*imports.columns, F.when(relative, target).otherwise(plain).alias("key"), F.when(relative, 0).otherwise(1).alias("exact"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports``: (importing_file, name); ``files``: (path). Adds ``path`` of the module, null if external.

    Every file is known under all suffixes of its path, so each try is an equi-join; ties go to the first path in order.
    """
    index = import_index(files.select("path")).groupBy("key", "exact").agg(F.min(F.struct("rank", "path")).alias("best"))
    wanted = import_keys(imports.select("importing_file", "name"))
    # never broadcast: the planner goes by the size of files, which says nothing of the keys made of their rows
    return wanted.join(index.hint("merge"), ["key", "exact"], "left").select("importing_file", "name", F.col("best.path").alias("path"))


def resolve_imports_at(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports``: (importing_file, name, pos); ``files``: (path, lo, hi), there from position ``lo`` below ``hi`` (null: to the end).

    As :func:`resolve_imports`, among the files that are there at the import's position. Of the files of a key that stay
    for good only those count that are better than all that came before: a key that a third of all files answer to, such as
    the name of a usual index file, keeps few.
    """
    index = import_index(files.select("path", "lo", "hi")).withColumn("best", F.struct("rank", "path"))
    stays = index.filter("hi IS NULL").groupBy("key", "exact", "lo").agg(F.min("best").alias("best"))
    line = Window.partitionBy("key", "exact").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    stays = stays.withColumn("before", F.min("best").over(line)).filter("before IS NULL OR best < before").select("key", "exact", "lo", F.lit(None).cast("long").alias("hi"), "best")
    index = stays.unionByName(index.filter("hi IS NOT NULL").select("key", "exact", "lo", "hi", "best"))
    wanted = import_keys(imports.select("importing_file", "name", "pos").distinct())
    there = F.when((F.col("lo") <= F.col("pos")) & (F.col("hi").isNull() | (F.col("pos") < F.col("hi"))), F.col("best"))
    return wanted.join(index.hint("merge"), ["key", "exact"], "left").groupBy("importing_file", "name", "pos").agg(F.min(there).alias("best")).select("importing_file", "name", "pos", F.col("best.path").alias("path"))


def unpivot(rows: DataFrame, entity: Column, attributes: dict[str, Column]) -> DataFrame:
    """Wide rows to (e, a, v); null values give no fact."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), c.cast("string").alias("v")) for a, c in attributes.items()])
    return rows.select(entity.alias("e"), F.explode(pairs).alias("p")).select("e", "p.a", "p.v").filter("v IS NOT NULL")


def checkpoint_due(elapsed_s: Column, last_cost_s: Column, duty: float = 0.05) -> Column:
    """Whether compaction may run again without taking more than its share of the time."""
    return elapsed_s >= last_cost_s * (1 / duty - 1)


def extract_python(files: DataFrame) -> DataFrame:
    """``files``: (path, source). (path, entity_type, name, tokens) of Python functions, classes and variables.

    Sources that do not parse give nothing. Other languages need a grammar that is not installed here.
    """
    ship_package(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [x for path, source in zip(pdf["path"], pdf["source"], strict=True) for x in python_entities(path, source)]
            yield pd.DataFrame(out, columns=["path", "entity_type", "name", "tokens"])

    return files.select("path", "source").mapInPandas(run, "path string, entity_type string, name string, tokens array<string>")


def python_entities(path: str, source: str | None) -> list[tuple[str, str, str, list[str]]]:
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return []
    out = []

    def leaves(node: ast.AST) -> list[str]:
        return [str(v) for n in ast.walk(node) for _, v in ast.iter_fields(n) if isinstance(v, (str, int, float, bytes))]

    def visit(node: ast.AST, owner: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append((path, "function", owner + child.name, leaves(child)))
            elif isinstance(child, ast.ClassDef):
                out.append((path, "class", owner + child.name, leaves(child)))
                visit(child, f"{owner}{child.name}.")
            elif isinstance(child, (ast.Assign, ast.AnnAssign)):
                targets = child.targets if isinstance(child, ast.Assign) else [child.target]
                out.extend((path, "field" if owner else "variable", owner + t.id, leaves(child)) for t in targets if isinstance(t, ast.Name))

    visit(tree, "")
    return out


def linearize(commits: DataFrame) -> DataFrame:
    """``commits``: (hash, parents). (hash, level): each commit above all its parents, whatever the dates.

    Commits with one parent that has no other child form chains; a chain is followed by doubling and counts as one node,
    whose length is the weight of its edges. What is left takes a round for every ``STEPS`` merges or forks on a path.
    ``row_number`` over (level, hash) makes a position of it.
    """
    nodes = commits.select("hash").distinct()
    edges = materialize(commits.select("hash", F.explode("parents").alias("parent")).distinct(), "parents")
    if edges.join(nodes.withColumnRenamed("hash", "parent"), "parent", "left_anti").take(1):
        raise ValueError("parents that are missing")
    single = edges.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("hash")
    lone = edges.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("parent")
    ends = chain_ends(edges.join(single, "hash", "left_semi").join(lone, "parent", "left_semi").select(F.col("hash").alias("src"), F.col("parent").alias("dst")))
    placed = nodes.join(ends, F.col("hash") == F.col("src"), "left").select("hash", F.coalesce("last", "hash").alias("head"), F.coalesce("hops", F.lit(0)).cast("long").alias("hops"))
    placed = materialize(placed, "placed")
    heads = placed.filter("hash = head").select("head")
    up = edges.join(heads.withColumnRenamed("head", "hash"), "hash", "left_semi").join(placed.withColumnRenamed("hash", "parent"), "parent")
    up = materialize(up.select(F.col("hash").alias("to"), F.col("head").alias("at"), (F.col("hops") + 1).alias("far")).distinct(), "contracted")
    needs = materialize(heads.join(up.groupBy(F.col("to").alias("head")).agg(F.count(F.lit(1)).alias("n")), "head", "left").select("head", F.coalesce("n", F.lit(0)).alias("n")), "needs")
    total, known = needs.count(), 0
    done = materialize(needs.filter("n = 0").select("head", F.lit(0).cast("long").alias("level")), "level")
    while (now := done.count()) < total:
        if now == known:
            raise ValueError("parents that form a circle")
        known = now
        for _ in range(STEPS):
            met = up.join(done.withColumnRenamed("head", "at"), "at").groupBy("to").agg(F.count(F.lit(1)).alias("met"), F.max(F.col("level") + F.col("far")).alias("level"))
            fresh = met.join(needs.withColumnRenamed("head", "to"), "to").filter("met = n").select(F.col("to").alias("head"), "level")
            done = done.filter("level = 0").unionByName(fresh).groupBy("head").agg(F.max("level").alias("level"))
        done = materialize(done, "level")
    return placed.join(done, "head").select("hash", (F.col("level") + F.col("hops")).alias("level"))


def tag_facts(tags: DataFrame, commits: DataFrame) -> DataFrame:
    """``tags``: (name, hash, date); ``commits``: (hash, …). Facts (e, a, v) of tags on known commits."""
    from factloom.functions.idents import commit_ident, slug

    t = tags.join(commits.select("hash").distinct(), "hash")
    return unpivot(t, F.concat(F.lit(":tag/"), slug(F.col("name"))), {":name": F.col("name"), ":date": F.col("date"), ":tagged-commit": commit_ident(F.col("hash"))})


def resolve_submodules(placeholders: DataFrame, submodules: DataFrame) -> DataFrame:
    """``placeholders``: (e, name) of unresolved imports; ``submodules``: (e, path). ``:resolves-to`` edges by a name
    that starts with the last part of a submodule's path, or equals it."""
    sub = submodules.select(F.col("e").alias("v"), F.element_at(F.split("path", "/"), -1).alias("first"))
    own = placeholders.select("e", F.regexp_extract("name", r"^([^./]+)", 1).alias("first"))
    return own.join(sub, "first").select("e", F.lit(":resolves-to").alias("a"), "v")
