"""Keyed side tables: lexicon, document history, example domains, catalog, memberships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import no_accents, normal_renderings
from weftgraph.operators.ordering import in_order, placed


# --- lexicon -------------------------------------------------------------------------------------
def entry_applies(subject: str | None = None, grade: str | None = None) -> Column:
    """An entry without a subject or grade always applies."""
    one = lambda c, v: F.lit(True) if v is None else F.col(c).isNull() | (F.col(c) == v)
    return one("subject", subject) & one("grade", grade)


def glossary_entries(nodes: DataFrame) -> DataFrame:
    """(id, renderings, subject, grade, tags) of nodes whose type or label is LexiconEntry."""
    found = nodes.where((F.col("type") == "LexiconEntry") | F.array_contains("labels", "LexiconEntry"))
    p = F.from_json("props", "renderings map<string,string>, subject string, grade string, tags array<string>")
    return found.select("id", *(p[c].alias(c) for c in ("renderings", "subject", "grade", "tags")))


def matching_terms(lexicon: DataFrame, query: str, limit: int | None = 20, languages: list[str] | None = None) -> DataFrame:
    """Entries with a rendering, of some languages or of any, that holds the query, without regard to accents and case; first by id."""
    from weftgraph.functions.text import without_accents

    wanted = without_accents(query) or ""
    held = F.map_values("renderings" if languages is None else F.map_filter("renderings", lambda k, _: k.isin(languages)))
    shown = lexicon.select("*", F.explode(held).alias("_r")).where(F.contains(no_accents(F.col("_r")), F.lit(wanted)))
    found = lexicon.join(shown.select("id").distinct(), "id", "left_semi")
    return found if limit is None else found.orderBy("id").limit(limit)


def terms_in(passages: DataFrame, lexicon: DataFrame, gram: int = 3) -> DataFrame:
    """(passage_id, id): the entries of which a rendering stands in the passage, accents and case aside.

    Candidates meet by the rarest three-letter piece of each rendering, so this is an equi join; renderings
    under three letters are met by their text among the pieces of that length.
    """
    texts = passages.select("passage_id", no_accents(F.col("text")).alias("text"))
    parts = lexicon.select("id", F.explode(F.map_values("renderings")).alias("r")).select("id", no_accents(F.col("r")).alias("r")).where(F.length("r") > 0).distinct()

    def pieces(text: Column, n: Column) -> Column:
        # A look ahead at each place finds all pieces in one pass; substrings by place would take a pass each.
        return F.regexp_extract_all(text, F.concat(F.lit("(?s)(?=(.{"), n.cast("string"), F.lit("}))")), F.lit(1))

    all_of = parts.select("id", "r", F.least(F.length("r"), F.lit(gram)).alias("n")).select("id", "r", "n", F.explode(F.array_distinct(pieces(F.col("r"), F.col("n")))).alias("piece"))
    lengths = [n for n in range(1, gram + 1)]
    cut = F.array_distinct(F.flatten(F.array(*(pieces(F.col("text"), F.lit(n)) for n in lengths))))
    known = all_of.select("piece").distinct()
    spread = texts.select("passage_id", F.explode(cut).alias("piece")).join(known, "piece")
    often = spread.groupBy("piece").agg(F.count("*").alias("seen"))
    rarest = all_of.join(often, "piece").groupBy("id", "r").agg(F.min_by("piece", F.struct("seen", "piece")).alias("piece"))
    candidates = spread.join(rarest, "piece").join(texts, "passage_id")
    return candidates.where(F.contains("text", F.col("r"))).select("passage_id", "id").distinct()


def merged_entry(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with renderings merged by language (a blank one removes it) and other fields replaced where given."""
    fields = [c for c in new.columns if c not in ("id", "renderings")]
    both = old.alias("o").join(new.alias("n"), "id", "left")
    fresh = F.coalesce(F.col("n.renderings"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    kept = F.map_filter(F.col("o.renderings"), lambda k, v: ~F.map_contains_key(fresh, k))
    return both.select("id", normal_renderings(F.map_concat(kept, fresh)).alias("renderings"), *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in fields))


def new_terms(source: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of (fr, wo, ...) that are not there yet, each pair once."""
    return source.dropDuplicates(["fr", "wo"]).join(existing.select("fr", "wo"), (source.fr.eqNullSafe(existing.fr)) & (source.wo.eqNullSafe(existing.wo)), "left_anti")


def added_terms(lexicon: DataFrame, new: DataFrame) -> DataFrame:
    """The lexicon with new entries; one without any text is refused, as is an identifier in use."""
    rows = new.withColumn("renderings", normal_renderings(F.col("renderings")))
    if rows.where(F.size("renderings") == 0).take(1):
        raise ValueError("an entry needs a text in some language")
    if rows.join(lexicon.select("id"), "id", "left_semi").take(1):
        raise ValueError("an identifier is in use")
    return lexicon.unionByName(rows.select(*lexicon.columns))


def edited_terms(lexicon: DataFrame, changes: DataFrame) -> DataFrame:
    """The lexicon with entries merged as ``merged_entry`` does; an unknown entry, or one left without text, is refused."""
    if changes.join(lexicon.select("id"), "id", "left_anti").take(1):
        raise ValueError("an entry is unknown")
    out = merged_entry(lexicon, changes)
    if out.join(changes.select("id"), "id", "left_semi").where(F.size("renderings") == 0).take(1):
        raise ValueError("an entry needs a text in some language")
    return out


def removed_terms(lexicon: DataFrame, ids: DataFrame) -> DataFrame:
    if ids.join(lexicon.select("id"), "id", "left_anti").take(1):
        raise ValueError("an entry is unknown")
    return lexicon.join(ids.select("id"), "id", "left_anti")


def section_order(terms: DataFrame) -> DataFrame:
    """(id, section, section_place, place): sections in the order of their first entries (by id), entries by name, both from 0.

    ``terms`` are (id, name, section). A section's entries are placed by ranges.
    """
    first = in_order(terms.groupBy("section").agg(F.min("id").alias("_first")), "_first", name="_n").select("section", (F.col("_n") - 1).alias("section_place"))
    return placed(terms, "section", "name", "id").join(first, "section").select("id", "section", "section_place", "place")


def section_counts(terms: DataFrame) -> DataFrame:
    """(section, n, first): counts by section, the null one included, with the place where it is first seen."""
    return terms.groupBy("section").agg(F.count("*").alias("n"), F.min("place").alias("first"))


# --- documents -----------------------------------------------------------------------------------
def reconciled(history: DataFrame, bucket: DataFrame) -> DataFrame:
    """(relPath, state): unchanged, modified, missing (only recorded), or new (only stored)."""
    h, b = history.select("relPath", F.col("md5").alias("was"), F.lit(True).alias("h")), bucket.select("relPath", F.col("md5").alias("now"), F.lit(True).alias("b"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("h").isNull(), "new").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("modified")
    return h.join(b, "relPath", "full_outer").select("relPath", state.alias("state"))


def reconcile_counts(states: DataFrame) -> DataFrame:
    """One row (unchanged, modified, missing, new, total) of the states that ``reconciled`` found."""
    return states.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("unchanged", "modified", "missing", "new")), F.count("*").alias("total"))


def survivors(history: DataFrame, bucket: DataFrame) -> DataFrame:
    """The history after a reconcile: what is still stored, with its present digest."""
    return history.drop("md5").join(bucket.select("relPath", "md5"), "relPath")


def documents_page(history: DataFrame, ordinals: DataFrame, limit: int = 25, after: tuple[float | None, str] | None = None) -> DataFrame:
    """Documents by (ordinal, nulls last, nodeId): one page after a cursor of both."""
    rows = history.join(ordinals, "nodeId", "left")
    if after is not None:
        at, node = after
        later = F.col("nodeId") > node
        rows = rows.where(F.col("ordinal").isNull() & later if at is None else F.col("ordinal").isNull() | (F.col("ordinal") > at) | ((F.col("ordinal") == at) & later))
    return rows.orderBy(F.col("ordinal").asc_nulls_last(), "nodeId").limit(min(max(1, limit), 100))


def recorded(history: DataFrame, entry: DataFrame) -> DataFrame:
    """History with an entry replaced by node, or added."""
    return history.join(entry.select("nodeId"), "nodeId", "left_anti").unionByName(entry)


def document_record(history: DataFrame, edges: DataFrame, document: str) -> DataFrame:
    """The history entry of a document: that of what it covers, else its own; the first by node."""
    covered = edges.where((F.col("type") == "covers") & (F.col("src") == document)).select(F.col("dst").alias("nodeId"), F.lit(0).alias("rank"))
    own = history.sparkSession.createDataFrame([(document, 1)], "nodeId string, rank int")
    return history.join(covered.unionByName(own), "nodeId").orderBy("rank", "nodeId").limit(1).drop("rank")


def documents_only(files: DataFrame) -> DataFrame:
    """Listed paths that are documents: .docx in any case, no folder marks, no lock files."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(F.lower(name).endswith(".docx") & ~name.startswith("~$") & ~F.col("path").endswith("/"))


# --- example domains -----------------------------------------------------------------------------
def domain_usage(used: DataFrame) -> DataFrame:
    """(domain, ordinals): where each domain, in lower case, has been used, in order."""
    return used.groupBy(F.lower("domain").alias("domain")).agg(F.sort_array(F.collect_set("ordinal")).alias("ordinals"))


def nearby_domains(used: DataFrame, reach: int) -> DataFrame:
    """(ordinal, domain): domains used at another ordinal at most ``reach`` away.

    Each use is sent to the ordinals around it, which is an equi join instead of a band join.
    """
    present = used.select("ordinal").distinct()
    rows = used.select(F.lower("domain").alias("domain"), "ordinal").distinct()
    near = rows.select("domain", F.explode(F.sequence(F.col("ordinal") - reach, F.col("ordinal") + reach)).alias("at"), "ordinal").where("at <> ordinal")
    return near.join(present.select(F.col("ordinal").alias("at")), "at", "left_semi").select(F.col("at").alias("ordinal"), "domain").distinct()


def neighbourhood(used: DataFrame, ordinal: int, reach: int) -> DataFrame:
    """(ordinal, domains): for each ordinal within reach of one, itself not, the domains used there, each once, in the order of their first use.

    ``used`` are (ordinal, domain, seq). A list has at most the domains that there are.
    """
    near = used.where((F.abs(F.col("ordinal") - ordinal) <= reach) & (F.col("ordinal") != ordinal))
    first = near.groupBy("ordinal", "domain").agg(F.min("seq").alias("first"))
    return first.groupBy("ordinal").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "domain"))), lambda x: x["domain"]).alias("domains"))


def fresh_domain(pool: DataFrame, used: DataFrame, ordinal: int, reach: int) -> DataFrame:
    """One row (domain): the first of the pool (domain, place) never used, else the one last used longest ago; none nearby."""
    usage = used.groupBy(F.lower("domain").alias("domain")).agg(F.max("ordinal").alias("last"), F.max((F.abs(F.col("ordinal") - ordinal) <= reach) & (F.col("ordinal") != ordinal)).alias("near"))
    rows = pool.withColumn("key", F.lower("domain")).join(usage.withColumnRenamed("domain", "key"), "key", "left").where(~F.coalesce("near", F.lit(False)))
    return rows.orderBy(F.col("last").isNotNull(), F.col("last").asc_nulls_first(), "place").limit(1).select("domain")


# --- memberships ---------------------------------------------------------------------------------
# Roles from the lowest to the highest, and the lowest that each action takes.
ROLES = ("curator", "approver", "admin", "super_admin")
NEEDED = {
    "apply": "curator", "discard": "curator", "readDraft": "curator", "publish": "approver", "readAudit": "approver", "manageMembers": "admin",
    "manageWorkspace": "super_admin",
}
#: Super admins are named in a setting.
MOST_SUPER_ADMINS = 1000


def memberships(rows: DataFrame) -> DataFrame:
    """(userId, roles map): the last role in each workspace wins."""
    last = rows.groupBy("userId", "workspace").agg(F.max_by("role", "seq").alias("role"))
    return last.groupBy("userId").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("workspace", "role")))).alias("roles"))


def rank(role: Column) -> Column:
    return F.coalesce(*(F.when(role == r, i + 1) for i, r in enumerate(ROLES)), F.lit(0))


def effective_roles(users: DataFrame, rows: DataFrame, default_workspace: str) -> DataFrame:
    """(userId, workspace, role): super admins everywhere, else the membership, else a legacy role in the default workspace."""
    mine = rows.groupBy("userId", "workspace").agg(F.max_by("role", "seq").alias("role"))
    legacy = users.where(F.col("legacyRole").isNotNull()).select("userId", F.lit(default_workspace).alias("workspace"), F.col("legacyRole").alias("role"))
    legacy = legacy.join(mine.select("userId", "workspace"), ["userId", "workspace"], "left_anti")
    plain = mine.unionByName(legacy).join(users.where("superAdmin").select("userId"), "userId", "left_anti")
    named = users.where("superAdmin").select("userId").distinct()
    if named.limit(MOST_SUPER_ADMINS + 1).count() > MOST_SUPER_ADMINS:
        raise ValueError(f"more than {MOST_SUPER_ADMINS} super admins")
    everywhere = rows.select("workspace").distinct().join(F.broadcast(named), F.lit(True)).select("userId", "workspace", F.lit("super_admin").alias("role"))
    return plain.unionByName(everywhere)


def allowed(roles: DataFrame, needed: str) -> DataFrame:
    return roles.where(rank(F.col("role")) >= rank(F.lit(needed)))


def verdicts(requests: DataFrame, roles: DataFrame) -> DataFrame:
    """Requests (userId, action, workspace, known) with role, allowed, and why not: no identity, no role, or the role it needs."""
    asked = requests.join(roles.select("userId", "workspace", "role"), ["userId", "workspace"], "left").withColumn("role", F.when(F.col("known"), F.col("role")))
    needs = F.coalesce(*(F.when(F.col("action") == a, r) for a, r in NEEDED.items()))
    may = F.coalesce(rank(F.col("role")) >= rank(needs), F.lit(False)) & F.col("role").isNotNull()
    why = F.when(~F.col("known"), "no identity").when(F.col("role").isNull(), "no role").when(~may, F.coalesce(F.concat(F.lit("needs "), needs), F.lit("unknown action")))
    return asked.withColumn("allowed", may).withColumn("why", why)


def last_admin(rows: DataFrame) -> DataFrame:
    """Workspaces where one admin is left."""
    return rows.where("role = 'admin'").groupBy("workspace").agg(F.countDistinct("userId").alias("n")).where("n <= 1").select("workspace")


# --- catalog -------------------------------------------------------------------------------------
def catalog_entries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind, name, steps, material_count): routines that no routine holds, with their ordered steps."""
    title = F.coalesce(F.nullif(F.get_json_object("props", "$.name"), F.lit("")), F.get_json_object("props", "$.description"), F.col("id"))
    order = F.coalesce(F.get_json_object("props", "$.position").cast("double"), F.get_json_object("props", "$.metadata.order").cast("double"), F.lit(0.0))
    n = nodes.select("id", "type", title.alias("name"), order.alias("ord"), F.coalesce(F.get_json_object("props", "$.metadata.kind"), F.lower("type")).alias("kind"))
    held = edges.where("type = 'hasPart'").select("src", "dst")
    routines = n.where("type = 'InstructionalRoutine'")
    inner = held.join(routines.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    tops = routines.join(inner, "id", "left_anti")
    kids = held.join(n, F.col("dst") == F.col("id")).select("src", "dst", "type", "name", "ord")
    steps = kids.where("type <> 'Material'").groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dst", "name"))), lambda s: s["name"]).alias("steps"))
    direct = kids.where("type = 'Material'").select("src", F.col("dst").alias("m"))
    below = kids.where("type <> 'Material'").select("src", F.col("dst").alias("mid")).join(direct.select(F.col("src").alias("mid"), "m"), "mid").select("src", "m")
    counted = direct.unionByName(below).groupBy("src").agg(F.count("*").alias("material_count"))
    rows = tops.join(steps, F.col("id") == F.col("src"), "left").drop("src").join(counted, F.col("id") == F.col("src"), "left").drop("src")
    return rows.select("id", "kind", "name", F.coalesce("steps", F.array().cast("array<string>")).alias("steps"), F.coalesce("material_count", F.lit(0)).alias("material_count"))


def cloned(nodes: DataFrame, edges: DataFrame, ids: DataFrame, stamp: str, minted: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Copies of the nodes ``ids`` and the containment among them under new ids; also the map (old_id, new_id).

    ``minted`` (old_id, new_id) gives new ids; those that it lacks are derived from the stamp and the old one. An id twice in it is an error.
    """
    from weftgraph.operators.rewrite import derived_id, edge_id
    from weftgraph.operators.traverse import induced

    derived = derived_id(F.concat_ws("/", F.lit(stamp), "old_id"))
    renamed = ids.select(F.col("id").alias("old_id"))
    if minted is None:
        renamed = renamed.withColumn("new_id", derived)
    else:
        if any(minted.groupBy(c).count().where("count > 1").take(1) for c in ("old_id", "new_id")):
            raise ValueError("an identifier is minted twice")
        renamed = renamed.join(minted.select("old_id", "new_id"), "old_id", "left").withColumn("new_id", F.coalesce("new_id", derived))
    copies = nodes.join(renamed, F.col("id") == F.col("old_id")).select(F.col("new_id").alias("id"), "type", "labels", "props")
    links = induced(edges, ids, ["hasPart"]).join(renamed.select(F.col("old_id").alias("src"), F.col("new_id").alias("s")), "src").join(renamed.select(F.col("old_id").alias("dst"), F.col("new_id").alias("d")), "dst")
    own = ["props"] if "props" in links.columns else []
    links = links.select("type", F.col("s").alias("src"), F.col("d").alias("dst"), *own).withColumn("id", edge_id()).select("id", "type", "src", "dst", *own)
    return copies, links, renamed


def rubric(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, sections, criteria_count): each rubric with ordered sections of ordered criteria."""
    order = F.coalesce(F.get_json_object("props", "$.position").cast("double"), F.lit(0.0))
    n = nodes.select("id", "type", F.coalesce(F.get_json_object("props", "$.description"), F.col("id")).alias("name"), order.alias("ord"))
    kids = edges.where("type = 'hasPart'").select("src", "dst").join(n, F.col("dst") == F.col("id")).drop("id")
    criteria = kids.where("type = 'RubricCriterion'").groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "dst", "name"))), lambda c: c["name"]).alias("criteria"))
    sections = kids.where("type = 'RubricSection'").join(criteria.withColumnRenamed("src", "_s"), F.col("dst") == F.col("_s"), "left")
    sections = sections.withColumn("criteria", F.coalesce("criteria", F.array().cast("array<string>")))
    grouped = sections.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("ord", "dst", "name", "criteria"))).alias("s"), F.sum(F.size("criteria")).alias("criteria_count"))
    return n.where("type = 'Rubric'").select("id").join(grouped, F.col("id") == F.col("src"), "left").select("id", F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["criteria"].alias("criteria"))).alias("sections"), F.coalesce("criteria_count", F.lit(0)).alias("criteria_count"))
