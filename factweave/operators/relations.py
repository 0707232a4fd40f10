"""Relations of sentences: the default matcher, confidence rules and predicate categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as tx
from ..sources.checkpoints import checkpointed
from .ranking import top_per_key

MIN_CONFIDENCE = 0.75


def lexicon_relations(sentences: DataFrame, lexicon: list[tuple[str, str, str, float]], text: str = "sentence") -> DataFrame:
    """Default relation provider: a trigger phrase between two words names a relation.

    `lexicon` rows are (trigger, predicate, category, confidence), a fixed table that becomes one
    regex: text before the trigger gives the head (its last word), text after it the tail (its first
    word). All triggers of a sentence are reported, in order of appearance.
    """
    triggers = "|".join(sorted((t for t, *_ in lexicon), key=len, reverse=True))
    word = r"[\p{L}\p{N}_]+"
    shape = rf"({word}) (?=({triggers}) ({word}))"
    part = lambda g: F.regexp_extract_all(F.col(text), F.lit(shape), F.lit(g))
    rows = sentences.withColumns({"__h": part(1), "__t": part(2), "__o": part(3)})
    rows = rows.where(F.size("__h") > 0).select(
        "*", F.posexplode(F.arrays_zip(F.col("__h").alias("head"), F.col("__t").alias("trigger"), F.col("__o").alias("tail"))).alias("rel_idx", "r"))
    mapping = lambda i: F.create_map(*[F.lit(x) for row in lexicon for x in (row[0], row[i])])
    trigger = F.col("r.trigger")
    return rows.drop("__h", "__t", "__o").withColumns({
        "head": F.col("r.head"), "tail": F.col("r.tail"), "predicate": mapping(1)[trigger],
        "predicate_category": mapping(2)[trigger], "confidence": mapping(3)[trigger].cast("double"),
    }).drop("r")


def accepted_relations(df: DataFrame, keys: list[str] | None = None, order: list[Column] = (), k: int | None = None,
                       min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Relations at or above the threshold; with keys ranked per key by confidence, and with k only the k best."""
    kept = df.where(F.col("confidence") >= min_confidence)
    return kept if keys is None else top_per_key(kept, keys, [F.desc("confidence"), *order], k, "rank")


def _num(*numbers: Column) -> Column:
    """First non-zero one of numbers in JSON text."""
    return F.coalesce(*[F.nullif(n.try_cast("double"), F.lit(0.0)) for n in numbers])


NAMES = (("head", "source", "subject"), ("tail", "target", "object"))


def parse_relation(j: Column) -> Column:
    """struct<head,tail,confidence> of a relation given as JSON in any of its usual shapes.

    [head, tail], [head, tail, score], or an object with head/source/subject, tail/target/object
    and score/confidence/prob on the relation or on its ends. Confidence: the relation's own, else
    the smaller of the ends, else either end, else 0.5; zero counts as absent.

    The text is bound once, its members are read in one go, and those of an end only where the end is an object.
    """
    return tx.bind(j, lambda text: F.when(text.startswith("["), _listed(text)).otherwise(_named(text)))


def _listed(j: Column) -> Column:
    """An end is a text or an object with a text; a null in the list is the text "null"."""
    def parsed(items: Column) -> Column:
        item = lambda i: F.when(F.size(items) > i, F.coalesce(F.get(items, F.lit(i)), F.lit("null")))
        inside = lambda i, f: F.when(item(i).startswith("{"), F.get_json_object(j, f"$[{i}].{f}"))
        end = lambda i: F.coalesce(inside(i, "text"), item(i))
        own = lambda i: F.coalesce(inside(i, "score").try_cast("double"), inside(i, "confidence").try_cast("double"), F.lit(0.5))
        conf = F.when(F.size(items) > 2, F.coalesce(_num(item(2)), F.lit(0.5))).otherwise(F.least(own(0), own(1)))
        return F.struct(end(0).alias("head"), end(1).alias("tail"), conf.alias("confidence"))

    return tx.bind(F.from_json(j, "array<string>"), parsed)


def _named(j: Column) -> Column:
    texts, numbers = ("text", "name", "span"), ("score", "confidence", "prob")
    fields = ", ".join(f"{f}: string" for f in (*texts, *numbers))

    def side(top: Column, keys: tuple[str, ...]) -> Column:
        # an end that is an object is read from the whole text, as a text may look like an object too
        objects = F.struct(*[F.when(top[k].startswith("{"), F.from_json(j, f"{k} struct<{fields}>")[k]).alias(k) for k in keys])
        plain = [tx.blank_to_null(F.when(~top[k].rlike(r"^[{\[]"), top[k])) for k in keys]
        return tx.bind(objects, lambda o: F.struct(
            F.coalesce(*[tx.blank_to_null(o[k][f]) for k in keys for f in texts], *plain, F.lit("")).alias("text"), _num(*[o[k][f] for k in keys for f in numbers]).alias("confidence")))

    def parsed(top: Column) -> Column:
        # least skips what is null: the smaller of both, else the one there is
        conf = lambda ends: F.coalesce(_num(*[top[f] for f in numbers]), F.least(ends["h"]["confidence"], ends["t"]["confidence"]), F.lit(0.5))
        both = F.struct(side(top, NAMES[0]).alias("h"), side(top, NAMES[1]).alias("t"))
        return tx.bind(both, lambda ends: F.struct(ends["h"]["text"].alias("head"), ends["t"]["text"].alias("tail"), conf(ends).alias("confidence")))

    return tx.bind(F.from_json(j, ", ".join(f"{k} string" for k in (*NAMES[0], *NAMES[1], *numbers))), parsed)


def infer_entity_type(text: Column, entities: Column) -> Column:
    """Type of the first entity (array<struct<kind,text>>) equal to, inside or around the text."""
    low = F.lower(text)
    hit = F.filter(entities, lambda e: F.lower(e["text"]).contains(low) | low.contains(F.lower(e["text"])))
    kinds = F.create_map(*[F.lit(x) for kv in fixed.NER_TYPE_MAP.items() for x in kv])
    return F.when(F.size(hit) > 0, F.coalesce(kinds[F.lower(F.get(hit, F.lit(0))["kind"])], F.lit("UNKNOWN"))).otherwise("UNKNOWN")


def predicate_category(predicate: Column, table: list[tuple[str, str, str]] = fixed.PREDICATE_TABLE) -> Column:
    """Category of a predicate: exact name first, then lower case with blanks and hyphens as "_"."""
    lookup = F.create_map(*[F.lit(x) for cat, pred, _ in table for x in (pred, cat)])
    return F.coalesce(lookup[predicate], lookup[F.translate(F.lower(predicate), " -", "__")])


def classify_distinct(df: DataFrame, text: str, classifier, default_confidence: float = 0.85) -> DataFrame:
    """Runs a text classifier (Column -> struct<label,confidence>) once per distinct text and joins back.

    The answers are kept in the checkpoint folder: a condition on them would else be moved below the distinct, and the
    classifier with it, to every row.
    """
    once = checkpointed(df.select(text).distinct().withColumn("__c", classifier(F.col(text))))
    once = once.select(text, F.col("__c.label").alias("label"), F.coalesce(F.col("__c.confidence"), F.lit(default_confidence)).alias("label_confidence"))
    return df.join(once, text, "left")


def latest_classification(log: DataFrame, order: str) -> DataFrame:
    """Last write per (source_text, label_type) of a classification log."""
    rest = [c for c in log.columns if c not in ("source_text", "label_type")]
    last = log.groupBy("source_text", "label_type").agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("v"))
    return last.select("source_text", "label_type", "v.*")
