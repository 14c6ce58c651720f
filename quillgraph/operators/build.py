"""From model replies to a resolved graph: cleaning, resolution, merging.

Evidence is the source of truth: a relation's weight, evidence and description
are aggregates of (relation, chunk) rows, so writing twice changes nothing and
removal is an anti-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import chunk_id, entity_id, name_key, normalize_name, snake_case
from ..schema import ENTITY_TYPES
from .graph import placed

EXTRACTION = "struct<entities:array<struct<name:string,type:string,description:string,aliases:array<string>>>,relations:array<struct<source:string,target:string,predicate:string,description:string,strength:int>>>"
PROMPT_VERSION = "extract-v4"
# fixed values: failure ratio, candidates a kind, thresholds, descriptions kept
FAILED_RATIO, CANDIDATES, AUTO_MERGE, ASK_FROM, DESCRIPTIONS = 0.2, 3, 1.0, 0.75, 5


# --- extraction -----------------------------------------------------------


def clean_entities(extracted: DataFrame, types: list[str] = ENTITY_TYPES) -> DataFrame:
    """chunk_id, result (EXTRACTION) in; one row an entity of a chunk out.

    Entities of one normal name merge: the first type and description win and
    aliases are united; unknown types become the last type, or Other.
    """
    e = extracted.select("chunk_id", F.posexplode("result.entities").alias("pos", "e")).withColumn("norm", normalize_name(F.col("e.name"))).where("norm <> ''")
    known = F.create_map(*[x for t in types for x in (F.lit(t.lower()), F.lit(t))])
    fallback = "Other" if "Other" in types else types[-1]
    first = lambda f, null=False: F.min_by(f"e.{f}", "pos") if not null else F.min_by(f"e.{f}", F.when(F.length(F.trim(f"e.{f}")) > 0, F.col("pos")))
    out = e.groupBy("chunk_id", "norm").agg(
        F.min("pos").alias("pos"), first("name").alias("name"), first("type").alias("_type"), first("description", True).alias("description"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("e.aliases", F.array().cast("array<string>")))))).alias("aliases"),
    )
    kind = F.coalesce(F.try_element_at(known, F.lower(F.trim("_type"))), F.lit(fallback))
    return out.select("chunk_id", "pos", "norm", F.trim("name").alias("name"), kind.alias("type"), F.coalesce("description", F.lit("")).alias("description"), "aliases")


def clean_relations(extracted: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations between known, distinct entities of a chunk; the first of a kind wins."""
    r = extracted.select("chunk_id", F.posexplode("result.relations").alias("rpos", "r"))
    # in one pass, as entities are costly to take twice: an entity's normal name, then its aliases
    alias = F.struct(F.lit(None).cast("string").alias("a"), F.lit(0).alias("via"))
    aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("a"), F.lit(1).alias("via")))
    names = entities.select("chunk_id", "norm", "pos", F.inline(F.concat(F.array(alias), aliases)))
    names = names.withColumn("key", F.when(F.col("via") == 0, F.col("norm")).otherwise(normalize_name(F.col("a"))))
    names = names.groupBy("chunk_id", "key").agg(F.min_by("norm", F.struct("via", "pos")).alias("norm"))
    for end, field in (("src", "source"), ("dst", "target")):
        r = r.withColumn("key", normalize_name(F.col(f"r.{field}"))).join(names.withColumnRenamed("norm", end), ["chunk_id", "key"]).drop("key")
    r = r.where("src <> dst").withColumn("predicate", snake_case(F.col("r.predicate")))
    r = r.groupBy("chunk_id", "src", "dst", "predicate").agg(F.min_by("r", "rpos").alias("r"), F.min("rpos").alias("pos"))
    strength = F.least(F.lit(10), F.greatest(F.lit(1), F.coalesce("r.strength", F.lit(1))))
    return r.select("chunk_id", "src", "predicate", "dst", strength.alias("strength"), F.coalesce("r.description", F.lit("")).alias("description"), "pos")


def cached_extraction(chunks: DataFrame, cache: DataFrame, version: str, model: str, any_version: bool = True) -> DataFrame:
    """Each chunk's cached reply: the exact version, else the latest of any."""
    exact = cache.where((F.col("prompt_version") == version) & (F.col("model") == model)).groupBy("chunk_id").agg(F.max_by("result_json", "seq").alias("exact"))
    out = chunks.select("chunk_id").join(exact, "chunk_id", "left")
    if any_version:
        out = out.join(cache.groupBy("chunk_id").agg(F.max_by("result_json", "seq").alias("last")), "chunk_id", "left")
    else:
        out = out.withColumn("last", F.lit(None).cast("string"))
    return out.select("chunk_id", F.coalesce("exact", "last").alias("result_json"), F.col("exact").isNotNull().alias("is_exact"))


def stale_types(cache: DataFrame, current_hash: str) -> DataFrame:
    """One row: does any chunk's latest extraction have another type set?"""
    last = cache.groupBy("chunk_id").agg(F.max_by("prompt_version", "seq").alias("v"))
    return last.agg(F.coalesce(F.bool_or(F.substring_index("v", ":", -1) != current_hash), F.lit(False)).alias("stale"))


def failed_documents(results: DataFrame, ratio: float = FAILED_RATIO) -> DataFrame:
    """doc_id, failed, total, over: documents whose failed share is too large."""
    per = results.groupBy("doc_id").agg(F.count_if(F.col("error").isNotNull()).alias("failed"), F.count(F.lit(1)).alias("total"))
    return per.withColumn("over", F.col("failed") > F.lit(ratio) * F.col("total"))


# --- resolution -----------------------------------------------------------


def key_candidates(entities: DataFrame, known: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """new_id, candidate_id, pos: known entities that share a name key.

    A key that many entities share is cut to the ``limit`` least ids per key
    before the join (all that any entity could use), so no key fans out.
    """
    have = known.select(F.col("entity_id").alias("candidate_id"), F.explode("name_keys").alias("k")).distinct()
    have = have.withColumn("_n", F.row_number().over(Window.partitionBy("k").orderBy("candidate_id"))).where(F.col("_n") <= limit + 1).drop("_n")
    want = entities.select(F.col("entity_id").alias("new_id"), F.explode("name_keys").alias("k"))
    hits = want.join(have, "k").where("new_id <> candidate_id").select("new_id", "candidate_id").distinct()
    order = Window.partitionBy("new_id").orderBy("candidate_id")
    return hits.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)


def candidates(by_key: DataFrame, by_vector: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """Name-key candidates first, then vector candidates (new_id, candidate_id,
    score) that aren't among them, up to ``limit`` of each."""
    rest = by_vector.where(F.col("score") >= ASK_FROM).join(by_key, ["new_id", "candidate_id"], "left_anti")
    order = Window.partitionBy("new_id").orderBy(F.desc("score"), "candidate_id")
    rest = rest.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)
    return by_key.select("new_id", "candidate_id", "pos", F.lit(None).cast("double").alias("score")).unionByName(rest.select("new_id", "candidate_id", (F.col("pos") + limit).alias("pos"), "score"))


def match(found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """First candidate that merges by score or was judged the same."""
    v = verdicts.select("new_id", "candidate_id", "same")
    ok = (F.coalesce("score", F.lit(0.0)) >= AUTO_MERGE) | F.coalesce("same", F.lit(False))
    return found.join(v, ["new_id", "candidate_id"], "left").where(ok).groupBy("new_id").agg(F.min_by("candidate_id", "pos").alias("entity_id"))


def resolve(new: DataFrame, known: DataFrame, by_vector: DataFrame, judge=None, cut=lambda df: df) -> DataFrame:
    """(new_id, entity_id): which new entities are known, or other new, ones.

    ``new`` and ``known``: entity_id, name, type, description, name_keys;
    ``by_vector``: (new_id, candidate_id, score).  An id that is known is itself.
    Else the first candidate (by name key, then by vector) that scores
    ``AUTO_MERGE`` or that ``judge``, a column function prompt -> struct<reply,
    error>, calls the same.  Among new entities only earlier ids are candidates, so
    there are no circles; chains are followed to their end.
    """
    columns = ["entity_id", "name", "type", "description", "name_keys"]
    fresh = new.select(*columns).join(known.select("entity_id"), "entity_id", "left_anti")
    every = known.select(*columns, F.lit(True).alias("_known")).unionByName(fresh.withColumn("_known", F.lit(False)))
    earlier = F.col("_known") | (F.col("candidate_id") < F.col("new_id"))
    marks = every.select(F.col("entity_id").alias("candidate_id"), "_known")
    keys = key_candidates(fresh, every, 4 * CANDIDATES).join(marks, "candidate_id").where(earlier)
    order = Window.partitionBy("new_id").orderBy(F.desc("_known"), "pos")
    keys = keys.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= CANDIDATES).select("new_id", "candidate_id", "pos")
    near = by_vector.join(fresh.select(F.col("entity_id").alias("new_id")), "new_id", "left_semi").join(marks, "candidate_id").where(earlier).select("new_id", "candidate_id", "score")
    found = cut(candidates(keys, near))
    if judge is None:
        verdicts = found.where("false").select("new_id", "candidate_id", F.lit(False).alias("same"))
    else:
        about = lambda side: every.select(F.col("entity_id").alias(f"{side}_id"), F.concat_ws(" | ", "name", "type", "description").alias(f"_{side}"))
        asked = found.where(F.coalesce("score", F.lit(0.0)) < AUTO_MERGE).join(about("new"), "new_id").join(about("candidate"), "candidate_id")
        reply = judge(F.concat(F.lit("Same entity? Answer same or different.\n"), "_new", F.lit("\n"), "_candidate"))
        verdicts = cut(asked.select("new_id", "candidate_id", reply.alias("_v")).select("new_id", "candidate_id", F.coalesce(F.lower(F.trim("_v.reply")).startswith("same"), F.lit(False)).alias("same")))
    step = cut(match(found, verdicts))
    while True:  # an earlier new entity may itself be another
        onward = step.select(F.col("new_id").alias("entity_id"), F.col("entity_id").alias("_next"))
        moved = step.join(onward, "entity_id", "left")
        if moved.where("_next IS NOT NULL").isEmpty():
            return step
        step = cut(moved.select("new_id", F.coalesce("_next", "entity_id").alias("entity_id")))


def resolved_entities(new: DataFrame, resolved: DataFrame) -> DataFrame:
    """``new`` under their resolved ids; those of one id are one row, which knows
    the others' names as aliases."""
    j = new.join(resolved.select(F.col("new_id").alias("entity_id"), F.col("entity_id").alias("_to")), "entity_id", "left").withColumn("_to", F.coalesce("_to", "entity_id"))
    first = F.struct(F.col("entity_id") != F.col("_to"), "entity_id")
    g = j.groupBy(F.col("_to").alias("entity_id")).agg(
        F.min_by("name", first).alias("name"), F.min_by("type", first).alias("type"),
        F.array_distinct(F.flatten(F.collect_list(F.array_append("aliases", F.col("name"))))).alias("_aliases"),
        F.array_sort(F.collect_list(F.struct(first.alias("at"), "descriptions"))).alias("_d"),
    )
    descriptions = F.array_distinct(F.flatten(F.transform("_d", lambda x: x["descriptions"])))
    return g.select("entity_id", "name", "type", F.array_sort(F.array_except("_aliases", F.array("name"))).alias("aliases"), descriptions.alias("descriptions"), F.array_join(descriptions, " ").alias("description"))


def same_key_groups(rows: DataFrame, kind: str, name: str, ident: str) -> DataFrame:
    """Resolution of a batch by type and name key: each row's first row of the group."""
    key = name_key(normalize_name(F.col(name)))
    w = rows.groupBy(F.col(kind).alias("type"), key.alias("key")).agg(F.min(ident).alias("canonical"), F.count(F.lit(1)).alias("members"))
    return rows.withColumn("key", key).join(w, (rows[kind] == w["type"]) & (key == w["key"])).select(F.col(ident).alias("id"), "canonical", "members")


def merge_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """old ⋈ new (entity_id, name, aliases, description): united aliases, plus
    the new name if it differs, and appended descriptions; ``changed`` tells."""
    n = new.select("entity_id", F.col("name").alias("n_name"), F.col("aliases").alias("n_aliases"), F.col("description").alias("n_description"))
    j = old.join(n, "entity_id")
    own = F.when(normalize_name(F.col("n_name")) != normalize_name(F.col("name")), F.array("n_name")).otherwise(F.array().cast("array<string>"))
    aliases = F.array_sort(F.array_except(F.array_union(F.array_union("aliases", "n_aliases"), own), F.array("name")))
    adds = (F.length("n_description") > 0) & ~F.array_contains("descriptions", F.col("n_description"))
    descriptions = F.when(adds, F.array_append("descriptions", F.col("n_description"))).otherwise(F.col("descriptions"))
    short = F.when(F.size(descriptions) > DESCRIPTIONS, F.array(F.array_join(descriptions, " "))).otherwise(descriptions)
    out = j.withColumn("_aliases", aliases).withColumn("_descriptions", short)
    changed = (F.col("_aliases") != F.array_sort("aliases")) | (F.col("_descriptions") != F.col("descriptions"))
    return out.withColumn("changed", changed).select("entity_id", "name", "type", F.col("_aliases").alias("aliases"), F.col("_descriptions").alias("descriptions"), F.array_join("_descriptions", " ").alias("description"), "changed")


def new_entities(cleaned: DataFrame) -> DataFrame:
    """Distinct entities of cleaned extractions with their ids and name keys."""
    from ..functions.text import entity_name_keys

    ident = entity_id(F.col("type"), F.col("norm"))
    g = cleaned.groupBy(ident.alias("entity_id")).agg(
        F.min_by("name", F.struct("chunk_id", "pos")).alias("name"), F.min_by("type", F.struct("chunk_id", "pos")).alias("type"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "pos", "description"))), lambda s: s["description"])).alias("descriptions"),
    )
    kept = F.filter("descriptions", lambda d: d != "")
    return g.select("entity_id", "name", "type", "aliases", kept.alias("descriptions"), F.array_join(kept, " ").alias("description"), entity_name_keys(F.concat(F.array("name"), "aliases")).alias("name_keys"))


# --- graph ----------------------------------------------------------------


def mentions_of(cleaned: DataFrame, resolved: DataFrame) -> DataFrame:
    """Mentions (chunk_id, entity_id); resolved: (norm, type, entity_id)."""
    return cleaned.join(resolved, ["norm", "type"]).select("chunk_id", "entity_id").distinct()


def add_evidence(old: DataFrame, new: DataFrame, chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """Old evidence and the rows of ``new`` that aren't there yet.

    Rows whose chunk or entity is unknown fall out; the first of a relation in a
    chunk counts.
    """
    key = ["src_id", "predicate", "dst_id", "chunk_id"]
    first = new.groupBy(*key).agg(F.min_by(F.struct("strength", "description", "seq"), "seq").alias("e")).select(*key, "e.*")
    ids = entities.select("entity_id")
    ok = first.join(chunks.select("chunk_id"), "chunk_id", "left_semi").join(ids.withColumnRenamed("entity_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("entity_id", "dst_id"), "dst_id", "left_semi")
    return old.unionByName(ok.join(old, key, "left_anti"), allowMissingColumns=True)


def relations(evidence: DataFrame) -> DataFrame:
    """weight, evidence, strengths and the longest, earliest description."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "chunk_id", "strength")))
    g = evidence.groupBy("src_id", "predicate", "dst_id").agg(
        F.sum("strength").cast("double").alias("weight"), listed.alias("_e"),
        F.max_by("description", F.struct(F.length("description"), -F.col("seq"))).alias("description"),
    )
    return g.select("src_id", "predicate", "dst_id", "weight", F.transform("_e", lambda e: e["chunk_id"]).alias("evidence"), F.transform("_e", lambda e: e["strength"]).alias("strengths"), "description")


def relation_weights(evidence: DataFrame) -> DataFrame:
    """The same without lists: what counts and ranks need."""
    return evidence.groupBy("src_id", "predicate", "dst_id").agg(F.sum("strength").cast("double").alias("weight"), F.count(F.lit(1)).alias("n_evidence"))


def mention_counts(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    n = mentions.groupBy("entity_id").agg(F.count_distinct("chunk_id").cast("int").alias("mention_count"))
    return entities.drop("mention_count").join(n, "entity_id", "left").withColumn("mention_count", F.coalesce("mention_count", F.lit(0)))


def next_edges(chunks: DataFrame) -> DataFrame:
    """NEXT edges between consecutive chunks of a document."""
    nxt = F.lead("chunk_id").over(Window.partitionBy("doc_id").orderBy("idx"))
    return chunks.select("doc_id", "chunk_id", nxt.alias("next_id")).where("next_id IS NOT NULL")


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Overwrite fields, keep mention counts, recompute the alias text."""
    kept = old.select("entity_id", F.col("mention_count").alias("_m"))
    fresh = new.drop("mention_count", "aliases_text").join(kept, "entity_id", "left").withColumn("mention_count", F.coalesce("_m", F.lit(0))).drop("_m").withColumn("aliases_text", F.array_join("aliases", " | "))
    return old.join(new.select("entity_id"), "entity_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


# --- removal --------------------------------------------------------------


def deletion_plan(mentions: DataFrame, chunks: DataFrame, doc_ids: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """doc_id, entity_id, mentions_in, mentions_out, removed for each document.

    Affected are the mentioned and the extra (doc_id, entity_id) entities;
    removed are those that nothing outside the document mentions.
    """
    per_doc = placed(mentions, chunks).groupBy("doc_id", "entity_id").agg(F.count(F.lit(1)).alias("mentions_in"))
    total = mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("mentions_all"))
    affected = per_doc.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    if extra is not None:
        affected = affected.unionByName(extra.join(affected, ["doc_id", "entity_id"], "left_anti").select("doc_id", "entity_id", F.lit(0).cast("long").alias("mentions_in")))
    out = affected.join(total, "entity_id", "left").withColumn("mentions_out", F.coalesce("mentions_all", F.lit(0)) - F.col("mentions_in"))
    return out.select("doc_id", "entity_id", "mentions_in", "mentions_out", (F.col("mentions_out") == 0).alias("removed"))


def delete_documents(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """Tables without the documents: chunks, mentions, evidence, entities, pages.

    Relations that lose evidence lose their description; without evidence they
    are gone.  Entities without mentions that the documents mentioned go, and
    their pages with them.
    """
    gone = tables["chunks"].join(doc_ids, "doc_id", "left_semi").select("chunk_id")
    touched = tables["mentions"].join(gone, "chunk_id", "left_semi").select("entity_id").distinct()
    mentions = tables["mentions"].join(gone, "chunk_id", "left_anti")
    key = ["src_id", "predicate", "dst_id"]
    lost = tables["relation_evidence"].join(gone, "chunk_id", "left_semi").select(*key).distinct().withColumn("_lost", F.lit(True))
    evidence = tables["relation_evidence"].join(gone, "chunk_id", "left_anti").join(lost, key, "left")
    evidence = evidence.withColumn("description", F.when(F.col("_lost"), "").otherwise(F.col("description"))).drop("_lost")
    dead = touched.join(mentions, "entity_id", "left_anti")
    entities = tables["entities"].join(dead, "entity_id", "left_anti")
    out = {"chunks": tables["chunks"].join(doc_ids, "doc_id", "left_anti"), "mentions": mentions, "relation_evidence": evidence, "entities": mention_counts(entities, mentions)}
    if "documents" in tables:
        out["documents"] = tables["documents"].join(doc_ids, "doc_id", "left_anti")
    if "wiki_pages" in tables:
        out["wiki_pages"] = tables["wiki_pages"].join(dead.withColumnRenamed("entity_id", "page_id"), "page_id", "left_anti")
    return out


def dirty_after_removal(plan: DataFrame, links: DataFrame, cites: DataFrame, gone_chunks: DataFrame) -> DataFrame:
    """Entities whose pages need new text: affected, linking to removed, citing."""
    removed = plan.where("removed").select("entity_id").distinct()
    linking = links.join(removed.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi").select(F.col("page_id").alias("entity_id"))
    citing = cites.join(gone_chunks.select("chunk_id"), "chunk_id", "left_semi").select(F.col("page_id").alias("entity_id"))
    return plan.select("entity_id").unionByName(linking).unionByName(citing).distinct().join(removed, "entity_id", "left_anti")


def chunk_key(doc_id: Column, idx: Column) -> Column:
    return chunk_id(doc_id, idx)
