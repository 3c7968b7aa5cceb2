"""Knowledge graph: triples to node and edge tables, export, neighbourhoods, text match."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import jsonx as J
from ..functions import text as X
from ..session import written
from ..sources.schemas import TRIPLE_JSON


def valid_triples(raw: DataFrame) -> DataFrame:
    """(id, source_text, response) -> (id, pos, s, cat_s, r, t, cat_t), incomplete ones dropped."""
    rows = (raw.filter(F.length("source_text") >= P.GRAPH_MIN_CHARS)
            .select("id", F.posexplode(F.from_json(J.embedded_array(F.col("response")), TRIPLE_JSON))
                    .alias("pos", "x"))
            .select("id", "pos", "x.*"))
    return rows.dropna(subset=["s", "cat_s", "r", "t", "cat_t"])


def node_key(name: Column) -> Column:
    """A node's id comes from its name, so no global numbering is needed."""
    return F.md5(name)


def nodes(triples: DataFrame) -> DataFrame:
    """One row per name; the first category written wins (map-side combined minimum)."""
    ends = triples.select(F.inline(F.array(
        F.struct(F.struct("id", "pos", F.lit(0)).alias("ord"), F.col("s").alias("name"),
                 F.col("cat_s").alias("category")),
        F.struct(F.struct("id", "pos", F.lit(1)).alias("ord"), F.col("t").alias("name"),
                 F.col("cat_t").alias("category")))))
    return (ends.groupBy("name").agg(F.min_by("category", "ord").alias("category"))
            .select(node_key(F.col("name")).alias("node_id"), "name", "category"))


def edges(triples: DataFrame) -> DataFrame:
    """Distinct (source, target, relation); self-loops are kept."""
    return triples.select(node_key(F.col("s")).alias("source_id"),
                          node_key(F.col("t")).alias("target_id"),
                          F.col("r").alias("relation")).distinct()


EDGE_KEY = ["source_id", "target_id", "relation"]


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(existing.select(*keys), keys, "left_anti").dropDuplicates(keys)


def links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by name; an edge with a missing end is dropped."""
    s = nodes.select(F.col("node_id").alias("source_id"), F.col("name").alias("source"))
    t = nodes.select(F.col("node_id").alias("target_id"), F.col("name").alias("target"))
    return (edges.join(s, "source_id").join(t, "target_id")
            .select("source", F.col("relation").alias("value"), "target"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(focus, neighbour) for every node of the graph."""
    return edges.select(F.inline(F.array(
        F.struct(F.col("source_id").alias("focus"), F.col("target_id").alias("neighbour")),
        F.struct(F.col("target_id").alias("focus"), F.col("source_id").alias("neighbour"))
    ))).distinct()


GRAM = 2


@dataclass
class NameIndex:
    """names (name, links): the links a name takes part in; grams (gram, pos, name) of one and of ``GRAM``
    characters, with the place where each stands (from 1); counts (gram, n)."""

    names: DataFrame
    grams: DataFrame
    counts: DataFrame


def _grams(text: Column, size: int) -> Column:
    """(pos, gram) of all grams of a text."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("pos"), F.substring(text, i, size).alias("gram")))


def name_index(links: DataFrame) -> NameIndex:
    """The positional gram index over the names in ``links`` (source, value, target), written once."""
    names = written(links.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("name"))
                    .groupBy("name").agg(F.count("*").alias("links")))
    both = F.concat(_grams(F.col("name"), 1), _grams(F.col("name"), GRAM))
    grams = written(names.select("name", F.inline(both)).select("gram", "pos", "name"))
    return NameIndex(names, grams, written(grams.groupBy("gram").agg(F.count("*").alias("n"))))


def token_names(tokens: DataFrame, index: NameIndex) -> DataFrame:
    """Distinct (token, name) where the name contains the token.

    A token is looked up by its rarest gram; a name that has it must hold the whole token at the
    place that the gram's own place tells. A gram that is nowhere ends a token at once.
    """
    asked = tokens.select("token").filter(F.length("token") > 0).distinct()
    size = F.when(F.length("token") < GRAM, _grams(F.col("token"), 1)).otherwise(_grams(F.col("token"), GRAM))
    parts = asked.select("token", F.size(size).alias("parts"), F.inline(size)).withColumnRenamed("pos", "off")
    rarest = (parts.join(index.counts, "gram").groupBy("token", "parts")
              .agg(F.count("*").alias("found"), F.min(F.struct("n", "off", "gram")).alias("r"))
              .filter("found = parts").select("token", F.col("r.gram").alias("gram"), F.col("r.off").alias("off")))
    start = F.col("pos") - F.col("off") + 1
    return (index.grams.join(rarest, "gram")
            .filter((start >= 1) & (F.substring(F.col("name"), start, F.length("token")) == F.col("token")))
            .select("token", "name").distinct())


def context_classes(queries: DataFrame, tokens: DataFrame, index: NameIndex) -> tuple[DataFrame, DataFrame]:
    """What the links around a query's words are, without a row for every pair of query and link.

    First (qid, token): a query's tokens that stand for a class of names, null for a query without any.
    Then the classes of these tokens: (token, name, links), a class being the names that contain the
    token. ``expand`` turns both into the links themselves.
    """
    classes = written(token_names(tokens, index))
    member = tokens.select("qid", "token").distinct().join(classes.select("token").distinct(), "token", "left_semi")
    none = queries.select("qid").join(member.select("qid").distinct(), "qid", "left_anti")
    members = member.select("qid", "token").unionByName(none.withColumn("token", F.lit(None).cast("string")))
    return members, classes.join(index.names, "name").select("token", "name", "links")


def expand(members: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct (qid, source, value, target): every link of every name in a class of a query's tokens.

    Names that contain the same tokens are looked up as one, so the queries of a link come from a table of
    pairs of such kinds. Only what is given out is a row per query and link, and it doesn't move.
    """
    kinds = written(classes.groupBy("name").agg(F.array_sort(F.collect_set("token")).alias("kind")))
    none = F.array().cast("array<string>")

    def of(end: str) -> DataFrame:
        return kinds.select(F.col("name").alias(end), F.col("kind").alias(f"{end}_kind"))

    placed = written(links.join(of("source"), "source", "left").join(of("target"), "target", "left")
                     .select("source", "value", "target", F.coalesce("source_kind", none).alias("source_kind"),
                             F.coalesce("target_kind", none).alias("target_kind"))
                     .filter((F.size("source_kind") > 0) | (F.size("target_kind") > 0)))
    pairs = placed.select("source_kind", "target_kind").distinct()
    asking = (pairs.withColumn("token", F.explode(F.array_union("source_kind", "target_kind")))
              .join(members.select("qid", "token"), "token")
              .groupBy("source_kind", "target_kind").agg(F.collect_set("qid").alias("qids")))
    return (placed.join(asking, ["source_kind", "target_kind"])
            .select(F.explode("qids").alias("qid"), "source", "value", "target"))


def expanded_lines(queries: DataFrame, tokens: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct (qid, line): the links around a query's words as text, or one placeholder line for a query
    without any."""
    members, classes = context_classes(queries, tokens, name_index(links))
    members = written(members)
    rows = expand(members.filter(F.col("token").isNotNull()), classes, links)
    parts = F.concat("source", "value", "target")
    line = X.triple_line(F.col("source"), F.col("value"), F.col("target")).alias("line")
    # only names that hold the marks of a line can give one line from two links
    marked = parts.contains("-") | parts.contains(">")
    none = members.filter(F.col("token").isNull()).select("qid", F.lit(P.NO_GRAPH_CONTEXT).alias("line"))
    return (rows.filter(~marked).select("qid", line)
            .unionByName(rows.filter(marked).select("qid", line).distinct()).unionByName(none))


def _substrings(name: Column, lengths: Column) -> Column:
    per_length = F.transform(lengths, lambda n: F.when(
        F.length(name) >= n,
        F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substring(name, i, n)))
        .otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(per_length))


def matched_names(tokens: DataFrame, links: DataFrame) -> DataFrame:
    """(qid, token) against the names in ``links`` -> distinct (qid, name) where the
    name contains one of the query's tokens.

    Containment is turned into an equality: a name is expanded into its
    substrings of the token lengths that occur (names are short), and those are
    joined to the distinct tokens. No nested loop, and no false candidates.
    """
    toks = tokens.select("token").distinct()
    lengths = toks.agg(F.collect_set(F.length("token"))).scalar()  # few distinct lengths
    names = (links.select(F.explode(F.array("source", "target")).alias("name")).distinct()
             .withColumn("ls", lengths))
    hits = (names.select("name", F.explode(_substrings(F.col("name"), F.col("ls"))).alias("token"))
            .join(toks, "token", "left_semi"))
    return tokens.join(hits, "token").select("qid", "name").distinct()


def mentions(names: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct (qid, source, value, target) with a matched source or target.

    ``names`` is (qid, name). Edges found by their target are kept only if their
    source did not match, so the union has no repeats and needs no shuffle of
    the (large) result to remove them.
    """
    source = names.select("qid", F.col("name").alias("source"))
    target = names.select("qid", F.col("name").alias("target"))
    by_source = links.join(source, "source").select("qid", "source", "value", "target")
    by_target = (links.join(target, "target").join(source, ["qid", "source"], "left_anti")
                 .select("qid", "source", "value", "target"))
    return by_source.unionByName(by_target)


def context_lines(queries: DataFrame, names: DataFrame, links: DataFrame) -> DataFrame:
    """(qid, line): matched edges as text, or one placeholder line for a query without any."""
    lines = mentions(names, links).select("qid", X.triple_line(
        F.col("source"), F.col("value"), F.col("target")).alias("line"))
    none = (queries.select("qid").join(names.select("qid").distinct(), "qid", "left_anti")
            .select("qid", F.lit(P.NO_GRAPH_CONTEXT).alias("line")))
    return lines.unionByName(none)
