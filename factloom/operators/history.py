"""Commits to facts, end to end: what a run of ingestion reads, derives and writes.

Every step is a DataFrame over all new commits at once. A run resumes after the commits that its watermark counts, takes
what it must know of earlier ones from the keyed last states beside the log (:mod:`factloom.sources.last_state`), and writes
one transaction. What it derives depends on a commit's position alone and not on where runs begin and end: a history taken
in pieces gives the facts that it gives at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import idents, texts
from factloom.model import FOREVER
from factloom.operators import ingest
from factloom.operators.versions import fold, last_supports, presence
from factloom.session import materialize
from factloom.sources import last_state

#: The version of ident rules that a graph is stamped with, and the entities of ingestion's own state.
FORMAT_VERSION = 1
WATERMARK, FORMAT, LAST_RUN = ":ingestion/watermark", ":ingestion/format-version", ":ingestion/last-run-at"
DESCRIPTION_CHARS, SUBJECT_CHARS = 120, 200


def _ms(iso: Column) -> Column:
    return F.unix_millis(F.to_timestamp(iso))


def commit_facts(commits: DataFrame) -> DataFrame:
    """``commits`` (hash, ts_iso, author, subject, parents): (e, a, v_type, v, vf_ms) of commit entities."""
    e, vf = idents.commit_ident(F.col("hash")), _ms(F.col("ts_iso"))
    own = {":entity-type": ("ref", F.lit(":type/commit")), ":ident": ("str", e), ":description": ("str", texts.cut(F.col("subject"), DESCRIPTION_CHARS)), ":hash": ("str", F.col("hash")), ":author": ("str", F.col("author")), ":subject": ("str", texts.cut(F.col("subject"), SUBJECT_CHARS)), ":date": ("str", F.col("ts_iso"))}
    one = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(t).alias("v_type"), v.alias("v")) for a, (t, v) in own.items()])
    parents = F.transform("parents", lambda p: F.struct(F.lit(":parent").alias("a"), F.lit("ref").alias("v_type"), idents.commit_ident(p).alias("v")))
    rows = commits.select(e.alias("e"), vf.alias("vf_ms"), F.explode(F.concat(one, parents)).alias("x"))
    return rows.select("e", "x.a", "x.v_type", "x.v", "vf_ms").filter("v IS NOT NULL")


def module_ident(path: Column) -> Column:
    return idents.code_ident(F.lit("module"), path, F.lit(None).cast("string"))


def code_facts(entities: DataFrame, carry: tuple[str, ...] = ("vf_ms",)) -> DataFrame:
    """``entities`` (path, entity_type, name, carried…), modules with a null name: (e, a, v_type, v, carried…), with ``:contains`` edges."""
    e = idents.code_ident(F.col("entity_type"), F.col("path"), F.col("name"))
    module = F.col("entity_type") == "module"
    pair = lambda a, t, v: F.struct(F.lit(a).alias("a"), F.lit(t).alias("v_type"), v.alias("v"))
    own = F.array(pair(":entity-type", "ref", F.concat(F.lit(":type/"), F.col("entity_type"))), pair(":ident", "str", e), pair(":description", "str", F.coalesce("name", "path")), F.struct(F.when(module, ":path").otherwise(":file").alias("a"), F.lit("str").alias("v_type"), F.col("path").alias("v")))
    facts = entities.select(e.alias("e"), *carry, F.explode(own).alias("x")).select("e", "x.a", "x.v_type", "x.v", *carry)
    inside = entities.filter(~module).select(module_ident(F.col("path")).alias("e"), F.lit(":contains").alias("a"), F.lit("ref").alias("v_type"), e.alias("v"), *carry)
    return facts.unionByName(inside)


def removed_entities(versions: DataFrame) -> DataFrame:
    """``versions`` (path, pos, status, idents): (path, pos, e) of entities that a version lacks and the one before had.

    A deleted file (status D) has none left; the order of a file's versions is that of positions.
    """
    now = F.when(F.col("status") == "D", F.array().cast("array<string>")).otherwise(F.col("idents"))
    before = F.lag("now").over(Window.partitionBy("path").orderBy("pos"))
    v = versions.select("path", "pos", now.alias("now")).withColumn("before", before)
    return v.select("path", "pos", F.explode(F.array_except("before", "now")).alias("e"))


def rename_facts(changes: DataFrame) -> DataFrame:
    """``changes`` (status, old_path, path, vf_ms): ``:renamed-from`` and ``:renamed-to`` edges between modules."""
    old, new = module_ident(F.col("old_path")), module_ident(F.col("path"))
    both = F.array(F.struct(new.alias("e"), F.lit(":renamed-from").alias("a"), old.alias("v")), F.struct(old.alias("e"), F.lit(":renamed-to").alias("a"), new.alias("v")))
    rows = changes.filter(F.col("status") == "R").select(F.explode(both).alias("x"), "vf_ms")
    return rows.select("x.e", "x.a", F.lit("ref").alias("v_type"), "x.v", "vf_ms").filter("e <> v")


def submodule_facts(links: DataFrame, carry: tuple[str, ...] = ("vf_ms",)) -> DataFrame:
    """``links`` (path, pin, module_name, module_url, carried…) of submodules as they stand: (e, a, v_type, v, carried…)."""
    e = module_ident(F.col("path"))
    pair = lambda a, t, v: F.struct(F.lit(a).alias("a"), F.lit(t).alias("v_type"), v.alias("v"))
    own = F.array(
        pair(":entity-type", "ref", F.lit(":type/external-dependency")), pair(":ident", "str", e), pair(":description", "str", F.coalesce("module_name", "path")), pair(":path", "str", F.col("path")),
        pair(":pinned-commit", "str", F.col("pin")), pair(":submodule-name", "str", F.col("module_name")), pair(":submodule-url", "str", F.col("module_url")),
    )
    return links.select(e.alias("e"), *carry, F.explode(own).alias("x")).select("e", "x.a", "x.v_type", "x.v", *carry).filter("v IS NOT NULL")


# ingestion's own state

def state(live: DataFrame) -> dict[str, str]:
    """``entity attribute`` -> value of ingestion's own entities: a handful of rows. The parts of last states come as ``parts``."""
    rows = live.filter(F.col("e").startswith(":ingestion/")).select("e", "a", "v").collect()
    parts = sorted(r["v"] for r in rows if r["e"] == last_state.ENTITY and r["a"] == ":part")
    return {f"{r['e']} {r['a']}": r["v"] for r in rows} | ({"parts": ",".join(parts)} if parts else {})


def check_format(known: dict[str, str]) -> bool:
    """True if the graph is new and is to be stamped; refuses other versions. No stamp on a graph with state means version 0."""
    stamp = known.get(f"{FORMAT} :version")
    if stamp is None and not known:
        return True
    if stamp != str(FORMAT_VERSION):
        raise ValueError(f"the graph has format version {stamp or 0}, this is {FORMAT_VERSION}: ingest into a new path")
    return False


def state_facts(spark: SparkSession, new: bool, last: str, total: int, run_at: str, order: str = "", heads: list[str] | None = None) -> DataFrame:
    """(e, a, v_type, v, v_num) that ingestion's entities have after a run; ``order`` is the digest of what is taken."""
    rows = [(WATERMARK, ":description", "str", "git ingestion watermark", None), (WATERMARK, ":hash", "str", last, None), (WATERMARK, ":order", "str", order, None), (WATERMARK, ":heads", "str", ",".join(heads or [last]), None)]
    rows += [(LAST_RUN, ":description", "str", "last ingestion run", None), (LAST_RUN, ":last-run-at", "str", run_at, None), (LAST_RUN, ":last-commit", "str", last, None), (LAST_RUN, ":total-ingested", "int", str(total), float(total))]
    if new:
        rows += [(FORMAT, ":description", "str", "graph format version", None), (FORMAT, ":version", "int", str(FORMAT_VERSION), float(FORMAT_VERSION))]
    rows += [(e, ":entity-type", "ref", ":type/ingestion", None) for e in dict.fromkeys(r[0] for r in rows)]
    return spark.createDataFrame(rows, "e string, a string, v_type string, v string, v_num double")


# two streams that meet

def walk(touches: DataFrame, total: int, forward: int, reverse: int, steps: int) -> DataFrame:
    """``touches`` (e, pos, commit): (e, introduced_by, pos, provisional) after ``steps`` commits of two converging streams.

    The forward stream has taken the lowest positions for good, the reverse stream the highest on trial. What only the
    reverse stream has seen is a guess that each earlier commit moves; when the streams have met, every answer is that of
    the batch. A stop falls between commits, so any number of steps is a state to resume from.
    """
    cycle = forward + reverse
    done = min(max(steps, 0), total)
    low = min(done // cycle * forward + min(done % cycle, forward), total)
    high = total - (done - low)
    seen = touches.filter((F.col("pos") < low) | (F.col("pos") >= high))
    first = seen.groupBy("e").agg(F.min_by("commit", "pos").alias("introduced_by"), F.min("pos").alias("pos"))
    return first.withColumn("provisional", (F.col("pos") >= low) & F.lit(done < total))


# a run

FULL = ["e", "a", "v_type", "v", "v_num", "vf_ms", "vt_ms"]


def _open(facts: DataFrame) -> DataFrame:
    """Facts (e, a, v_type, v, vf_ms) as open-ended rows of a log."""
    return facts.withColumns({"v_num": F.lit(None).cast("double"), "vt_ms": F.lit(FOREVER)}).select(*FULL)


@dataclass
class Derived:
    """What a run derives from its changes: what it writes to the log, and the last states it leaves."""

    opened: DataFrame
    closed: DataFrame
    once: DataFrame
    states: dict[str, DataFrame]


def derive(changes: DataFrame, had: dict[str, DataFrame], start: int, ignore: tuple[str, ...] = texts.IGNORED) -> Derived:
    """``changes``: what git's ``blobs`` have, with ``vf_ms``, from position ``start`` on; ``had``: last states by kind."""
    changes = changes.withColumns({"ignored": texts.ignored_path(F.col("path"), ignore), "lang": texts.language(F.col("path")), "link": (F.col("mode") == ingest.GITLINK) & (F.col("status") != "D")})
    moved = changes.filter("status = 'R'").select(F.col("old_path").alias("path"), "pos", "vf_ms", F.lit(False).alias("present"), F.lit(False).alias("link"))
    is_file = (F.col("status") != "D") & (F.col("mode") != ingest.GITLINK) & F.col("lang").isNotNull()
    touched = changes.select("path", "pos", "vf_ms", is_file.alias("present"), "link").unionByName(moved)
    # a path that one file leaves and another takes in the same commit is there
    touched = materialize(touched.groupBy(F.col("path").alias("owner"), "pos").agg(F.min("vf_ms").alias("at_ms"), F.max("present").alias("present"), F.max("link").alias("link")), "touched")
    versions = touched.select("owner", "pos", "at_ms")
    when = changes.groupBy("pos", "hash").agg(F.min("vf_ms").alias("vf_ms"))
    code = changes.filter(is_file & ~F.col("ignored"))

    entities, bodies = _entities(code, changes.filter(~texts.ignored_path(F.col("old_path"), ignore)))
    links = changes.filter(F.col("link") & ~F.col("ignored")).select("path", "pos", F.col("blob").alias("pin"), "module_name", "module_url")
    deps = materialize(_dependencies(code, presence(touched.select("owner", "pos", "present"), had["paths"].select(F.col("key").alias("owner"))), ignore), "deps")
    parts = [
        code_facts(entities.select("path", "entity_type", "name", "pos", F.col("path").alias("owner")), ("owner", "pos")),
        submodule_facts(links.withColumn("owner", F.col("path")), ("owner", "pos")),
        deps.select(module_ident(F.col("path")).alias("e"), F.lit(":depends-on").alias("a"), F.lit("ref").alias("v_type"), "v", F.col("path").alias("owner"), "pos"),
    ]
    supports = materialize(parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct(), "supports")
    before = had["supports"].withColumnRenamed("key", "owner")
    opened, closed = fold(versions, supports, before)

    seen = entities.select("e", "path", "pos", "body_hash", (F.col("entity_type") == "module").alias("is_module"))
    seen = seen.unionByName(links.select(module_ident(F.col("path")).alias("e"), "path", "pos", F.col("pin").alias("body_hash"), F.lit(False).alias("is_module")))
    lineage, last_bodies = _lineage(seen, had["bodies"], when)
    names = entities.filter("name IS NOT NULL").groupBy(_simple(F.col("name")).alias("key")).agg(F.min("pos").alias("first_pos")).join(had["names"].select("key"), "key", "left_anti")
    names = materialize(names.withColumn("pos", F.col("first_pos")), "names")
    known = had["names"].select(F.col("key").alias("name"), "first_pos").unionByName(names.select(F.col("key").alias("name"), "first_pos"))
    renamed = ingest.rename_rounds(bodies, known).join(when.select(F.col("hash").alias("commit"), "vf_ms"), "commit")
    both = F.array(F.struct(F.col("renamed_to").alias("e"), F.lit(":renamed-from").alias("a"), F.col("renamed_from").alias("v")), F.struct(F.col("renamed_from").alias("e"), F.lit(":renamed-to").alias("a"), F.col("renamed_to").alias("v")))
    renamed = renamed.select(F.explode(both).alias("x"), "vf_ms").select("x.e", "x.a", F.lit("ref").alias("v_type"), "x.v", "vf_ms").filter("e <> v")

    stood = deps.filter("external IS NOT NULL").groupBy(F.col("v").alias("key")).agg(F.min(F.struct("pos", "external")).alias("m")).join(had["placeholders"].select("key"), "key", "left_anti")
    stood = stood.select("key", F.col("m.pos").alias("pos"), F.col("m.external").alias("name"), F.col("m.pos").alias("since")).join(when.select("pos", "vf_ms"), "pos")
    stood = materialize(stood.select("key", "pos", "name", "since", "vf_ms"), "placeholders")
    labels = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(t).alias("v_type"), v.alias("v")) for a, t, v in ((":entity-type", "ref", F.lit(":type/external-dependency")), (":ident", "str", F.col("key")), (":description", "str", F.col("name")))])
    labelled = stood.select(F.col("key").alias("e"), "vf_ms", F.explode(labels).alias("x")).select("e", "x.a", "x.v_type", "x.v", "vf_ms")
    linked = had["supports"].filter("a = ':pinned-commit'").select(F.col("key").alias("owner"))
    bridged, unbridged = _bridges(had["placeholders"].unionByName(stood.select(*had["placeholders"].columns)), presence(touched.select("owner", "pos", F.col("link").alias("present")), linked), when, start)

    once = _open(lineage.unionByName(renamed).unionByName(rename_facts(changes.filter(~F.col("ignored")))).unionByName(labelled).distinct())
    opened = opened.withColumn("v_num", F.lit(None).cast("double")).select(*FULL).unionByName(bridged.withColumn("v_num", F.lit(None).cast("double")).select(*FULL))
    states = {
        "supports": last_supports(versions, supports).withColumnRenamed("owner", "key"),
        "paths": touched.groupBy(F.col("owner").alias("key")).agg(F.max("pos").alias("pos"), F.max_by("present", "pos").alias("present")).withColumn("present", F.when(F.col("present"), F.lit(True))),
        "bodies": last_bodies,
        "names": names,
        "placeholders": stood,
    }
    return Derived(opened, closed.select("e", "a", "v", "at_ms").unionByName(unbridged), once, states)


def _simple(name: Column) -> Column:
    return F.element_at(F.split(name, "[.]"), -1)


def _entities(code: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (e, path, pos, entity_type, name, body_hash) of new versions, and the bodies that commits take away and bring."""
    python = changes.filter(texts.language(F.col("old_path")) == "python")
    sides = code.filter("lang = 'python'").select("path", "pos", "hash", F.lit("added").alias("side"), "source")
    sides = sides.unionByName(python.select(F.col("old_path").alias("path"), "pos", "hash", F.lit("removed").alias("side"), F.col("old_source").alias("source"))).filter("source IS NOT NULL")
    packed = sides.select(F.concat_ws("\x00", "path", F.col("pos").cast("string"), "hash", "side").alias("path"), "source")
    found = ingest.extract_python(packed).withColumn("k", F.split("path", "\x00"))
    ident = idents.code_ident(F.col("entity_type"), F.col("path"), F.col("name"))
    found = found.select(F.col("k")[0].alias("path"), F.col("k")[1].cast("long").alias("pos"), F.col("k")[2].alias("commit"), F.col("k")[3].alias("side"), "entity_type", "name", "tokens")
    found = materialize(found.withColumns({"e": ident, "body_hash": ingest.body_hash(F.col("tokens"))}), "entities")
    columns = ["e", "path", "pos", "entity_type", "name", "body_hash"]
    modules = code.select("path", "pos", F.lit("module").alias("entity_type"), F.lit(None).cast("string").alias("name"), F.sha2(F.coalesce("source", F.lit("")), 256).alias("body_hash")).withColumn("e", ident)
    one = found.groupBy("commit", "side", "e").agg(F.min(F.struct("pos", "entity_type", "name", "tokens")).alias("m"))
    other = one.select("commit", "e", F.when(F.col("side") == "added", "removed").otherwise("added").alias("side"))
    gone = one.join(other, ["commit", "e", "side"], "left_anti")
    bodies = gone.select("commit", "side", "e", "m.pos", "m.entity_type", _simple(F.col("m.name")).alias("name"), "m.tokens")
    return found.filter("side = 'added'").select(*columns).unionByName(modules.select(*columns)), bodies


def _dependencies(code: DataFrame, files: DataFrame, ignore: tuple[str, ...]) -> DataFrame:
    """(path, pos, v, external): what each version imports, among the files (owner, lo, hi) there at its position; ``external``
    is the name imported where it leads out of the repository or into a path that is left out."""
    names = code.filter("source IS NOT NULL").select("path", "pos", F.explode(texts.imports_of(F.col("lang"), F.col("source"))).alias("name"))
    found = ingest.resolve_imports_at(names.withColumnRenamed("path", "importing_file"), files.withColumnRenamed("owner", "path"))
    out = F.col("path").isNull() | texts.ignored_path(F.col("path"), ignore)
    target = F.coalesce(module_ident(F.col("path")), idents.canonical_ident(F.lit("module"), F.col("name")))
    return found.select(F.col("importing_file").alias("path"), "pos", target.alias("v"), F.when(out, F.col("name")).alias("external"))


def _lineage(seen: DataFrame, had: DataFrame, when: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of introduction and change by sightings (e, path, pos, body_hash, is_module), and the last bodies of their entities."""
    rows = seen.distinct().unionByName(had.select(F.col("key").alias("e"), F.lit("").alias("path"), F.lit(-1).cast("long").alias("pos"), "body_hash", F.lit(False).alias("is_module")))
    order = Window.partitionBy("e").orderBy("pos", "path")
    turns = rows.withColumns({"was": F.lag("body_hash").over(order), "first": F.lag("pos").over(order).isNull()}).filter("pos >= 0")
    kind = F.when(F.col("first"), ":introduced-by").when(F.col("is_module") | ~F.col("was").eqNullSafe(F.col("body_hash")), ":modified-in")
    facts = turns.withColumn("a", kind).filter("a IS NOT NULL").join(when, "pos").select("e", "a", F.lit("ref").alias("v_type"), idents.commit_ident(F.col("hash")).alias("v"), "vf_ms")
    last = seen.groupBy(F.col("e").alias("key")).agg(F.max("pos").alias("pos"), F.max_by("body_hash", F.struct("pos", "path")).alias("body_hash"))
    return facts, last


def _bridges(stood: DataFrame, links: DataFrame, when: DataFrame, start: int) -> tuple[DataFrame, DataFrame]:
    """``:resolves-to`` edges from placeholders (key, name, since, vf_ms) to submodules (owner, lo, hi): those that begin from
    position ``start`` on, and those of before that end; an edge holds from the later of both sightings on."""
    sub = links.select(module_ident(F.col("owner")).alias("v"), F.element_at(F.split("owner", "/"), -1).alias("first"), "lo", "hi")
    own = stood.select(F.col("key").alias("e"), F.regexp_extract("name", r"^([^./]+)", 1).alias("first"), "since", F.col("vf_ms").alias("since_ms"))
    met = own.join(sub, "first").withColumn("at", F.greatest("since", "lo")).filter("e <> v AND (hi IS NULL OR at < hi)")
    met = met.join(when.select(F.col("pos").alias("lo"), F.col("vf_ms").alias("lo_ms")), "lo", "left").join(when.select(F.col("pos").alias("hi"), F.col("vf_ms").alias("hi_ms")), "hi", "left")
    edge = met.withColumns({"a": F.lit(":resolves-to"), "v_type": F.lit("ref"), "vf_ms": F.when(F.col("since") >= F.col("lo"), F.col("since_ms")).otherwise(F.col("lo_ms"))})
    begun = edge.filter(F.col("at") >= start).withColumn("vt_ms", F.when(F.col("hi").isNull(), F.lit(FOREVER)).otherwise(F.greatest("hi_ms", "vf_ms")))
    return begun.select("e", "a", "v_type", "v", "vf_ms", "vt_ms"), edge.filter((F.col("at") < start) & F.col("hi").isNotNull()).select("e", "a", "v", F.col("hi_ms").alias("at_ms"))


def ingest_git(spark: SparkSession, store, repo: str, branch: str | None = None, run_at: str = "1970-01-01T00:00:00Z", most: int | None = None, ignore: tuple[str, ...] = ()) -> dict:
    """Take in the commits of ``repo`` that are not taken yet, ``most`` of them at most. Returns {commits, last, total, tx}.

    Paths that ``ignore``, the default list or the repository's ignore file name give no entities. A run that dies
    leaves nothing behind that a reader sees.
    """
    from factloom.sources import git_log

    live = store.facts().filter(F.col("tx_retracted").isNull() & (F.col("vt_ms") == FOREVER))
    known = state(live)
    new_graph = check_format(known)
    branch = branch or git_log.default_branch(repo)
    total = int(known.get(f"{LAST_RUN} :total-ingested", 0))
    was, heads = known.get(f"{WATERMARK} :order", ""), known.get(f"{WATERMARK} :heads", "").split(",") if total else []
    whole = git_log.linearization(repo, branch)
    after = git_log.following(repo, branch, total, was, heads) if total else whole
    new = after if most is None else after[:most]
    if not new:
        return {"commits": 0, "last": known.get(f"{WATERMARK} :hash"), "total": total, "tx": None}
    how = ({"start": total, "was": was, "heads": heads} if total else {}) | ({} if most is None else {"most": most})
    commits = materialize(git_log.read(spark, repo, "commits", branch, **how), "commits")
    when = commits.select("pos", _ms(F.col("ts_iso")).alias("vf_ms"))
    changes = materialize(git_log.read(spark, repo, "blobs", branch, **how).join(when, "pos"), "blobs")
    states = last_state.LastState(spark, f"{store.path}/_states", known.get("parts", "").split(",") if "parts" in known else [])
    got = derive(changes, {k: states.read(k) for k in last_state.KINDS}, total, texts.IGNORED + git_log.ignore_patterns(repo) + tuple(ignore))
    tags = git_log.read(spark, repo, "tags")
    dated = tags.select(F.concat(F.lit(":tag/"), idents.slug(F.col("name"))).alias("e"), F.coalesce(_ms(F.col("date")), F.lit(0).cast("long")).alias("vf_ms"))
    taken = commits.select("hash").unionByName(live.filter("a = ':hash'").filter(~F.col("e").startswith(":ingestion/")).select(F.col("v").alias("hash")))
    tagged = ingest.tag_facts(tags, taken).join(dated, "e").select("e", "a", F.when(F.col("a") == ":tagged-commit", "ref").otherwise("str").alias("v_type"), "v", "vf_ms")
    once = got.once.unionByName(_open(commit_facts(commits).unionByName(tagged)))
    part, gone = states.write(got.states)
    at_ms = when.agg(F.max("vf_ms")).first()[0]
    row = lambda p: (last_state.ENTITY, ":part", "str", p, None, at_ms, FOREVER)
    opened = got.opened.unionByName(spark.createDataFrame([row(part)], "e string, a string, v_type string, v string, v_num double, vf_ms long, vt_ms long"))
    closed = got.closed.unionByName(spark.createDataFrame([(last_state.ENTITY, ":part", p, at_ms) for p in gone], "e string, a string, v string, at_ms long"))
    in_order = whole[: total + len(new)]
    follows = after == whole[total:] or len(in_order) == len(whole)
    ends = git_log.tips(repo, heads + new)
    tx = store.write(f"ingest {repo}", opened, closed, once, state_facts(spark, new_graph, new[-1], total + len(new), run_at, git_log.digest(in_order) if follows else "-", ends), at_ms)
    return {"commits": len(new), "last": new[-1], "total": total + len(new), "tx": tx}


def status(store) -> dict:
    """What ingestion has done so far."""
    live = store.facts().filter(F.col("tx_retracted").isNull() & (F.col("vt_ms") == FOREVER))
    known = state(live)
    return {"last_commit": known.get(f"{LAST_RUN} :last-commit"), "last_run_at": known.get(f"{LAST_RUN} :last-run-at"), "total": int(known.get(f"{LAST_RUN} :total-ingested", 0)), "format_version": int(known.get(f"{FORMAT} :version", 0))}
