"""Entity mentions, clustering, the bilingual index and its repairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondhan.functions.text import MARKS, WS, collapse, or_empty, split_words
from sondhan.operators.fuzzy import lcs_ratio_udf
from sondhan.operators.greedy import best_free, leader_clusters
from sondhan.operators.numbering import number_rows
from sondhan.session import checkpoint

# Known English-Bangla pairs.
SEED_PAIRS = {
    "bangladesh": "বাংলাদেশ", "dhaka": "ঢাকা", "chattogram": "চট্টগ্রাম", "chittagong": "চট্টগ্রাম", "sylhet": "সিলেট", "rajshahi": "রাজশাহী", "khulna": "খুলনা", "barishal": "বরিশাল",
    "rangpur": "রংপুর", "mymensingh": "ময়মনসিংহ", "comilla": "কুমিল্লা", "cumilla": "কুমিল্লা", "india": "ভারত", "pakistan": "পাকিস্তান", "kolkata": "কলকাতা", "bnp": "বিএনপি",
    "bangladesh nationalist party": "বাংলাদেশ জাতীয়তাবাদী দল", "awami league": "আওয়ামী লীগ", "jatiya party": "জাতীয় পার্টি", "jamaat-e-islami": "জামায়াতে ইসলামী", "jamaat": "জামায়াত",
    "election commission": "নির্বাচন কমিশন", "parliament": "সংসদ", "supreme court": "সুপ্রিম কোর্ট", "high court": "হাইকোর্ট", "dhaka university": "ঢাকা বিশ্ববিদ্যালয়",
    "sheikh hasina": "শেখ হাসিনা", "khaleda zia": "খালেদা জিয়া", "tarique rahman": "তারেক রহমান", "muhammad yunus": "মুহাম্মদ ইউনূস", "ziaur rahman": "জিয়াউর রহমান",
}

# Words that are no entity.
PARTICLES = ["এর", "কে", "যে", "ও"]


def seed_link(text: Column, lang: Column) -> Column:
    """The pair's other side; English without regard to case.  Where two English names share a Bangla one, the later holds."""
    en = F.create_map(*[F.lit(x) for pair in SEED_PAIRS.items() for x in pair])
    bn = F.create_map(*[F.lit(x) for pair in {v: k for k, v in SEED_PAIRS.items()}.items() for x in pair])
    return F.when(lang == "en", en[F.lower(F.trim(text))]).otherwise(bn[F.trim(text)])


def regex_mentions(text: Column) -> Column:
    """Built-in extractor: runs of two or more capitalised words, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(or_empty(text), F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)+"), F.lit(0)))


def mapped_entity(text: Column, kind: Column, names: dict[str, str]) -> Column:
    """``normalize_entity`` behind a map of names: the raw text is looked up first, then the normalised one."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<string,string>")
    plain = normalize_entity(text, kind)
    return F.coalesce(known[text], known[plain], plain)


def normalize_entity(text: Column, kind: Column) -> Column:
    """'' for single characters and particles; quotes, articles (of organisations) and possessives dropped."""
    t = F.regexp_replace(collapse(or_empty(text)), "^[\"'“”‘’]+|[\"'“”‘’]+$", "")
    t = F.when((F.length(t) <= 1) | t.isin(PARTICLES), "").otherwise(t)
    t = F.when(kind == "ORG", F.regexp_replace(t, "^(?i)(?:the|a|an) ", "")).otherwise(t)
    return F.trim(F.regexp_replace(t, "['’]s$", ""))


def entity_key(text: Column, kind: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(normalize_entity(text, kind)), MARKS, ""))


def mention_counts(mentions: DataFrame) -> DataFrame:
    """(lang, text, n, kind): counts of stripped surfaces of two or more characters; the kind is the label seen last.

    ``mentions``: (lang, text, label, seq).
    """
    rows = mentions.withColumn("text", F.regexp_replace("text", f"^{WS}+|{WS}+$", "")).filter(F.length("text") >= 2)
    return rows.groupBy("lang", "text").agg(F.count(F.lit(1)).alias("n"), F.max_by("label", "seq").alias("kind"))


def cluster_exact(counts: DataFrame) -> DataFrame:
    """(lang, key, kind, canonical, variants, mentions): one cluster a key and kind, named by its most frequent surface."""
    keyed = counts.withColumn("key", entity_key(F.col("text"), F.col("kind"))).filter("key <> ''")
    best = F.struct(F.col("n"), F.col("text"))
    return keyed.groupBy("lang", "key", "kind").agg(
        F.max_by("text", best).alias("canonical"), F.count(F.lit(1)).alias("variants"), F.sum("n").alias("mentions"), F.array_sort(F.collect_set("text")).alias("aliases"),
    )


def cluster_fuzzy(counts: DataFrame, threshold: float = 85.0) -> DataFrame:
    """(kind, leader, key): leader clustering of keys, the most frequent first; a key joins the first leader it resembles.

    Pairs are found by a blocked join that loses none: a ratio of ``threshold`` allows e
    letters to be inserted or removed, each of which spoils at most two bigrams, so two such
    keys share one of the 2 e + 1 rarest bigrams of each.  Candidates are verified exactly
    and the greedy order is replayed in rounds.
    """
    keyed = checkpoint(counts.withColumn("key", entity_key(F.col("text"), F.col("kind"))).filter("key <> ''").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    low, spare = threshold / (200 - threshold), 1 - threshold / 100
    pairs_of = F.transform(F.sequence(F.lit(1), F.greatest(F.length("key") - 1, F.lit(1))), lambda i: F.substring("key", i, F.lit(2)))
    seen = keyed.select("kind", "key", "n", F.explode(pairs_of).alias("g")).groupBy("kind", "key", "n", "g").agg(F.count(F.lit(1)).alias("times"))
    grams = seen.select("kind", "key", "n", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("times")), lambda t: F.concat(F.col("g"), t.cast("string")))).alias("g"))
    rare = grams.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    ranked = grams.join(rare, "g").groupBy("kind", "key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("gs"))
    head = (2 * F.floor(F.lit(spare) * F.length("key") * (1 + 1 / low) + 1e-9) + 1).cast("int")
    g = ranked.select("kind", "key", "n", F.explode(F.slice("gs", 1, head)).alias("x")).select("kind", "key", "n", F.col("x.g").alias("g"))
    h = g.select(F.col("kind").alias("k2"), F.col("key").alias("key2"), F.col("n").alias("n2"), "g")
    met = g.join(h, "g").filter(F.col("kind").eqNullSafe(F.col("k2")) & (F.col("key") < F.col("key2")) & (F.least(F.length("key"), F.length("key2")) >= low * F.greatest(F.length("key"), F.length("key2")) - 1e-9))
    pairs = checkpoint(met.select("kind", "key", "n", "key2", "n2").distinct().filter(lcs_ratio_udf("key", "key2") >= threshold))
    one, two = F.struct("kind", "key"), F.struct("kind", F.col("key2").alias("key"))
    turn, turn2 = F.struct((-F.col("n")).alias("n"), F.col("key").alias("k")), F.struct((-F.col("n2")).alias("n"), F.col("key2").alias("k"))
    before = turn < turn2
    led = leader_clusters(pairs.select(F.when(before, one).otherwise(two).alias("first"), F.when(before, two).otherwise(one).alias("then"), F.when(before, turn).otherwise(turn2).alias("turn")))
    led = led.select("member.kind", F.col("leader.key").alias("leader"), "member.key")
    alone = keyed.join(led.select(F.col("kind").alias("k2"), F.col("key").alias("key2")), F.col("kind").eqNullSafe(F.col("k2")) & (F.col("key") == F.col("key2")), "left_anti").select("kind", F.col("key").alias("leader"), "key")
    return led.unionByName(alone)


def entity_index(clusters: DataFrame) -> DataFrame:
    """Index rows: English clusters, Bangla ones merged into a seed-linked English cluster or rows of their own."""
    en = clusters.filter("lang = 'en'").withColumn("linked", seed_link(F.col("canonical"), F.lit("en")))
    bn = clusters.filter("lang = 'bn'").select(F.col("canonical").alias("linked"), F.col("mentions").alias("bn_mentions"), F.col("variants").alias("bn_variants"), F.col("aliases").alias("bn_aliases"), F.col("kind").alias("bn_kind"))
    joined = en.join(bn, "linked", "full_outer")
    rows = joined.select(
        F.col("canonical").alias("canonical_en"), F.when(F.col("bn_mentions").isNotNull(), F.col("linked")).alias("canonical_bn"), F.coalesce("kind", "bn_kind").alias("entity_type"),
        F.array_sort(F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("bn_aliases", F.array().cast("array<string>"))))).alias("aliases"),
        (F.coalesce("variants", F.lit(0)) + F.coalesce("bn_variants", F.lit(0))).alias("article_count"), (F.coalesce("mentions", F.lit(0)) + F.coalesce("bn_mentions", F.lit(0))).alias("total_mentions"),
    )
    return rows


def number_entities(index: DataFrame, order: list[str]) -> DataFrame:
    """entity_id E00000... in the given order; the order is total, so ids are stable."""
    return number_rows(index, order, "__i").withColumn("entity_id", F.format_string("E%05d", F.col("__i"))).drop("__i")


def index_stats(records: DataFrame) -> DataFrame:
    en, bn = or_empty(F.col("canonical_en")) != "", or_empty(F.col("canonical_bn")) != ""
    return records.agg(F.count(F.lit(1)).alias("total"), F.count_if(en).alias("with_en"), F.count_if(bn).alias("with_bn"), F.count_if(en & bn).alias("cross_linked"))


def nameless(records: DataFrame, k: int = 20) -> DataFrame:
    return records.filter((or_empty(F.col("canonical_en")) == "") & (or_empty(F.col("canonical_bn")) == "")).orderBy(F.desc_nulls_last("total_mentions"), "entity_id").limit(k)


def attach_ids(mentions: DataFrame, lookup: DataFrame) -> DataFrame:
    """Mentions with the entity id of the lower-case surface, else of the surface, else null.  ``lookup``: (name, entity_id), names unique."""
    low = lookup.select(F.col("name").alias("__l"), F.col("entity_id").alias("__a"))
    raw = lookup.select(F.col("name").alias("__r"), F.col("entity_id").alias("__b"))
    out = mentions.withColumn("__l", F.lower("text")).join(low, "__l", "left").join(raw, F.col("text") == F.col("__r"), "left")
    return out.withColumn("entity_id", F.coalesce("__a", "__b")).drop("__l", "__a", "__r", "__b")


def merge_links(records: DataFrame, links: DataFrame) -> DataFrame:
    """Fold linked Bangla rows into English ones: canonical, aliases and mentions move, the score stays, the Bangla row goes.

    ``links``: (en_id, bn_id, score), one to one.
    """
    none = F.array().cast("array<string>")
    bn = records.select(F.col("entity_id").alias("bn_id"), F.col("canonical_bn").alias("__bn"), F.col("aliases").alias("__al"), F.col("total_mentions").alias("__m"))
    pulled = links.join(bn, "bn_id").select(F.col("en_id").alias("entity_id"), "__bn", "__al", "__m", "score")
    kept = records.join(links.select(F.col("bn_id").alias("entity_id")), "entity_id", "left_anti").join(pulled, "entity_id", "left")
    linked = F.col("__bn").isNotNull()
    return kept.select(
        "entity_id", "canonical_en", F.when(linked, F.col("__bn")).otherwise(F.col("canonical_bn")).alias("canonical_bn"), F.concat(F.coalesce("aliases", none), F.coalesce("__al", none)).alias("aliases"), "entity_type",
        (F.coalesce("total_mentions", F.lit(0)) + F.coalesce("__m", F.lit(0))).cast("long").alias("total_mentions"), F.coalesce(F.col("score"), F.col("cross_lingual_score")).alias("cross_lingual_score"),
    )


def merge_duplicates(records: DataFrame, name: str) -> DataFrame:
    """One row a canonical name: the keeper is the row with an English name, then the smallest id; aliases join, mentions add up.

    Aggregates with map-side combine, so a name shared by a third of all rows is no hot task.  Returns (entity_id, name, aliases, total_mentions, merged).
    """
    named = records.filter(or_empty(F.col(name)) != "")
    rank = F.struct((or_empty(F.col("canonical_en")) == "").alias("no_en"), F.col("entity_id"))
    heads = named.groupBy(name).agg(F.min(rank).alias("keep"), F.sum(F.coalesce("total_mentions", F.lit(0))).cast("long").alias("total_mentions"), F.count(F.lit(1)).alias("merged"))
    listed = named.select(name, F.explode("aliases").alias("alias")).filter("alias is not null").distinct().groupBy(name).agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    return heads.join(listed, name, "left").select(F.col("keep.entity_id").alias("entity_id"), F.col(name).alias("name"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "total_mentions", "merged")


def id_map(records: DataFrame, name: str) -> DataFrame:
    """(old_id, entity_id) for rows folded into another by ``merge_duplicates``."""
    keep = merge_duplicates(records, name).select("name", F.col("entity_id").alias("keep"))
    rows = records.select(F.col("entity_id").alias("old_id"), F.col(name).alias("name")).join(keep, "name")
    return rows.filter("old_id <> keep").select("old_id", F.col("keep").alias("entity_id"))


def greedy_links(scored: DataFrame, threshold: float = 0.85, top: int = 3) -> DataFrame:
    """(en_id, bn_id, score): English rows in order take their best still free Bangla row among their ``top`` candidates.

    ``scored``: (kind, en_id, bn_id, score) of one kind.
    """
    w = Window.partitionBy("en_id").orderBy(F.desc("score"), "bn_id")
    best = scored.withColumn("rn", F.row_number().over(w)).filter((F.col("rn") <= top) & (F.col("score") >= threshold))
    return best_free(best.select(F.col("en_id").alias("a"), F.col("bn_id").alias("b"), F.col("rn").alias("place"), "score")).toDF("en_id", "bn_id", "score")


def apply_links(records: DataFrame, links: DataFrame) -> DataFrame:
    """Records whose Bangla name is empty take that of their link; the linked rows stay, unlike in ``merge_links``.

    ``links``: (en_id, bn_id), one to one.  Adds ``linked`` (whether a name was taken).
    """
    names = records.select(F.col("entity_id").alias("bn_id"), F.nullif(F.col("canonical_bn"), F.lit("")).alias("__bn"))
    pulled = links.select("en_id", "bn_id").join(names, "bn_id").select(F.col("en_id").alias("entity_id"), "__bn")
    empty = or_empty(F.col("canonical_bn")) == ""
    out = records.join(pulled, "entity_id", "left").withColumn("linked", empty & F.col("__bn").isNotNull())
    return out.withColumn("canonical_bn", F.when(F.col("linked"), F.col("__bn")).otherwise(F.col("canonical_bn"))).drop("__bn")


def recover_orphans(mentions: DataFrame, records: DataFrame, lookup: DataFrame) -> DataFrame:
    """(old_id, name, entity_id): ids that mentions carry but the index does not hold, by their most frequent text.

    ``mentions``: (entity_id, text); ties go to the smaller text.  ``entity_id`` is what ``lookup`` (name, entity_id) has for
    the lower-case, stripped text, else null: not recovered.
    """
    lost = mentions.filter("entity_id is not null").join(records.select("entity_id"), "entity_id", "left_anti")
    texts = lost.groupBy("entity_id", "text").agg(F.count(F.lit(1)).alias("n"))
    best = texts.groupBy(F.col("entity_id").alias("old_id")).agg(F.min(F.struct((-F.col("n")).alias("n"), "text")).alias("t")).select("old_id", F.col("t.text").alias("name"))
    key = F.trim(F.lower(F.col("text_")))
    return best.withColumnRenamed("name", "text_").withColumn("name", key).join(lookup, "name", "left").select("old_id", F.col("text_").alias("name"), "entity_id")


def gazetteer_mentions(docs: DataFrame, doc: str, text: str, names: DataFrame, most: int = 4) -> DataFrame:
    """(doc, text, label): the names of a table (name, label) that a text holds as windows of one to ``most`` words, each once.

    The names may be as many as there are: windows and names meet in a join.  Marks at the ends of words are no part of them.
    """
    w = F.filter(F.transform(split_words(F.col(text)), lambda x: F.regexp_replace(x, "^[\"'“‘(]+|[।,.;:!?)\"'”’]+$", "")), lambda x: x != "")
    rows = docs.select(F.col(doc), w.alias("w")).withColumn("n", F.explode(F.array(*[F.lit(i) for i in range(1, most + 1)]))).filter(F.size("w") >= F.col("n"))
    rows = rows.select(doc, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " ")))).alias("text"))
    return rows.join(names.select(F.col("name").alias("text"), "label"), "text").select(doc, "text", "label").distinct()


def rewrite_ids(mentions: DataFrame, mapping: DataFrame, known: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, entity_ids): ids mapped to their keepers, unknown ones dropped, distinct and sorted."""
    m = mapping.select(F.col("old_id").alias("__o"), F.col("entity_id").alias("__n"))
    ids = mentions.join(m, F.col("entity_id") == F.col("__o"), "left").select(doc, F.coalesce("__n", "entity_id").alias("entity_id")).distinct()
    return ids.join(known.select("entity_id").distinct(), "entity_id", "left_semi").groupBy(doc).agg(F.array_sort(F.collect_list("entity_id")).alias("entity_ids"))
