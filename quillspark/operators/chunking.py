"""Cutting documents into pages, sections and chunks.

A document is one row, so all cutting happens inside the row: no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P
from ..functions import text as X
from .concat import concat_ordered


def fixed_blocks(c: Column, width: int) -> Column:
    """Consecutive blocks of ``width`` characters; one linear pass over the text."""
    return F.regexp_extract_all(c, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))


def fixed_chunk_array(c: Column, size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP) -> Column:
    """Chunks of ``size`` characters, each sharing ``overlap`` with the next.

    Built from stride-wide blocks plus the head of the following block; a last
    block that the previous chunk already covers is dropped.
    """
    blocks = fixed_blocks(c, size - overlap)
    whole = F.transform(blocks, lambda b, i: F.struct(
        i.alias("i"), F.length(b).alias("own"),
        F.concat(b, F.coalesce(F.substring(F.get(blocks, i + 1), 1, overlap), F.lit("")))
        .alias("text")))
    kept = F.filter(whole, lambda x: (x["i"] == 0) | (x["own"] > overlap))
    return F.transform(kept, lambda x: x["text"])


def fixed_chunks(docs: DataFrame, size: int = P.CHUNK_SIZE,
                 overlap: int = P.CHUNK_OVERLAP) -> DataFrame:
    """(doc_id, text) -> (doc_id, chunk_idx, text)."""
    return docs.select("doc_id", F.posexplode(fixed_chunk_array(F.col("text"), size, overlap))
                       .alias("chunk_idx", "text"))


def page_batches(pages: DataFrame, batch: int = P.PAGE_BATCH) -> DataFrame:
    """(doc_id, page_no, text) -> one text per batch of pages, each page followed by a blank line.

    A group holds at most ``batch`` pages whatever the size of the document.
    """
    grouped = (pages.groupBy("doc_id", F.floor(F.col("page_no") / batch).cast("int").alias("batch_no"))
               .agg(F.sort_array(F.collect_list(F.struct("page_no", "text"))).alias("ps")))
    return grouped.select("doc_id", "batch_no", F.concat(
        F.array_join(F.transform("ps", lambda p: p["text"]), "\n\n"), F.lit("\n\n")).alias("text"))


def join_pages(pages: DataFrame, batch: int = P.PAGE_BATCH) -> DataFrame:
    """Whole documents out of their pages, broken sentences joined."""
    whole = concat_ordered(page_batches(pages, batch), ["doc_id"], "batch_no", "text", sep="")
    return whole.withColumn("text", X.join_broken_lines(F.col("text")))


def _heading(line: Column) -> Column:
    return F.struct(
        F.length(F.regexp_extract(line, P.HEADING, 1)).alias("level"),
        X.strip(F.regexp_extract(line, P.HEADING, 2)).alias("title"))


def heading_levels(lines: DataFrame) -> DataFrame:
    h = _heading(F.col("line"))
    return lines.withColumn("level", h["level"]).withColumn("title", h["title"])


def _fence(line: Column) -> Column:
    """What a line does to fences: 1 opens or closes one of backticks, 2 only closes it (a fence that ends in
    its own line opens none), 3 is one of tildes, 0 none."""
    mark = F.regexp_extract(line, P.FENCE, 1)
    return (F.when(mark == "~~~", 3).when(mark == "", 0)
            .when(F.regexp_extract(line, P.FENCE, 2).contains("```"), 2).otherwise(1))


def _after(state: Column, mark: Column) -> Column:
    """The state after a fence line: 0 outside, 1 inside backticks, 2 inside tildes."""
    return (F.when(state == 0, F.when(mark == 1, 1).when(mark == 3, 2).otherwise(0))
            .when(state == 1, F.when(mark < 3, 0).otherwise(1))
            .otherwise(F.when(mark == 3, 0).otherwise(2)))


def _fence_states(lines: DataFrame, block: int) -> DataFrame:
    """(doc_id, blk, before, marks) of the blocks of documents with fences.

    A block is a function from the state before it to the state after it. The functions
    are composed over the blocks of a document, so no task folds all its lines.
    """
    kind = _fence(F.col("line"))
    marks = (lines.select("doc_id", "pos", F.floor(F.col("pos") / block).alias("blk"), kind.alias("kind"))
             .filter("kind > 0").groupBy("doc_id", "blk")
             .agg(F.sort_array(F.collect_list(F.struct("pos", "kind"))).alias("marks")))
    ends = marks.withColumn("ends", F.array(*[
        F.aggregate("marks", F.lit(n), lambda state, m: _after(state, m["kind"])) for n in range(3)]))
    # one small row per block that has fences
    chains = ends.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("blk", "ends"))).alias("chain"),
                                        F.max("blk").alias("last"))
    known = chains.select("doc_id", F.explode(F.transform("chain", lambda c, i: F.struct(
        c["blk"].alias("blk"), F.aggregate(F.slice("chain", 1, i), F.lit(0), lambda state, x: F.get(x["ends"], state))
        .alias("before"), F.get(c["ends"], F.aggregate(
            F.slice("chain", 1, i), F.lit(0), lambda state, x: F.get(x["ends"], state))).alias("after")))).alias("c"))
    return known.select("doc_id", "c.*").join(marks, ["doc_id", "blk"])


def outside_fences(lines: DataFrame, block: int = 4096) -> DataFrame:
    """``lines`` (doc_id, pos, line) with ``open``: whether the line can be a heading."""
    from pyspark.sql import Window as W

    states = _fence_states(lines, block)
    blocks = lines.select("doc_id", F.floor(F.col("pos") / block).alias("blk")).distinct()
    so_far = W.partitionBy("doc_id").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    # blocks without fences are in the state that the last one with fences left
    placed = (blocks.join(states.select("doc_id", "blk", "after", "marks"), ["doc_id", "blk"], "left")
              .withColumn("before", F.coalesce(F.last("after", True).over(so_far), F.lit(0)))
              .select("doc_id", "blk", "before", "marks"))
    earlier = F.filter("marks", lambda m: m["pos"] < F.col("pos"))
    state = F.when(F.col("marks").isNull(), F.col("before")).otherwise(
        F.aggregate(earlier, F.col("before"), lambda state, m: _after(state, m["kind"])))
    return (lines.withColumn("blk", F.floor(F.col("pos") / block)).join(placed, ["doc_id", "blk"])
            .withColumn("open", state == 0).drop("blk", "before", "marks"))


def heading_path(lines: DataFrame, block: int = 4096) -> DataFrame:
    """(doc_id, pos, line) -> the same lines with the heading path in force at each.

    Headings may be indented, and none stands inside a fence. A running maximum of (pos, title)
    per level carries headings forward. It is taken in blocks of lines first and then over one
    summary row per block, so a document with very many lines never sits in a single sort.
    """
    from pyspark.sql import Window as W

    lv = range(1, 5)
    tagged = heading_levels(outside_fences(lines, block)).withColumn("blk", F.floor(F.col("pos") / block))
    marks = [F.when(F.col("open") & (F.col("level") == n), F.struct("pos", "title")) for n in lv]
    tagged = tagged.select("doc_id", "pos", "line", "blk",
                           *[m.alias(f"m{n}") for n, m in zip(lv, marks)])
    inside = (W.partitionBy("doc_id", "blk").orderBy("pos")
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    local = tagged.select("doc_id", "pos", "line", "blk",
                          *[F.max(f"m{n}").over(inside).alias(f"m{n}") for n in lv])
    summary = tagged.groupBy("doc_id", "blk").agg(*[F.max(f"m{n}").alias(f"m{n}") for n in lv])
    before = (W.partitionBy("doc_id").orderBy("blk").rowsBetween(W.unboundedPreceding, -1))
    carried = summary.select("doc_id", "blk",
                             *[F.max(f"m{n}").over(before).alias(f"c{n}") for n in lv])
    joined = local.join(carried, ["doc_id", "blk"])
    # a heading is in force unless a shallower one came later
    parts, latest = [], F.lit(-1)
    for n in lv:
        m = F.coalesce(F.col(f"m{n}"), F.col(f"c{n}"))
        alive = m["pos"] > latest
        parts.append(F.when(alive, m["title"]))
        latest = F.greatest(latest, F.coalesce(m["pos"], F.lit(-1)))
    return joined.select("doc_id", "pos", "line",
                         path_text(F.array_compact(F.array(*parts))).alias("path"))


def path_text(parts: Column) -> Column:
    return F.when(F.size(parts) > 0, F.array_join(parts, " > ")).otherwise(P.DEFAULT_PATH)


_MARK = re.compile(r"^[ \t]*(?:(#{1,4}) ([^\n]*)|(```|~~~)([^\n]*))", re.M)


def cut_sections(text: str) -> list[tuple[str, str]]:
    """(path, content) of the sections of a text, cut in front of every heading outside fences; linear."""
    heads: list[tuple[int, int, str]] = []
    fence = None
    for m in _MARK.finditer(text):
        if m[3] and fence is None:
            fence = None if m[3] == "```" and "```" in m[4] else m[3]
        elif m[3]:
            fence = None if m[3] == fence else fence
        elif fence is None:
            heads.append((m.start(), len(m[1]), m[2].strip(P.SPACES)))
    if not heads or heads[0][0] > 0:
        heads.insert(0, (0, 0, ""))
    ends = [start - 1 for start, _, _ in heads[1:]] + [len(text)]
    titles: list[str | None] = [None] * 4
    found = []
    for (start, level, title), end in zip(heads, ends):
        if level:
            titles[level - 1:] = [title] + [None] * (4 - level)
        own = [x for x in titles if x is not None]
        found.append((" > ".join(own) if own else P.DEFAULT_PATH, text[start:end]))
    return found


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, section_no, path, content), headings kept in the content.

    A null text has no section.
    """
    schema = T.StructType([docs.schema["doc_id"],
                           *T.StructType.fromDDL("section_no INT, path STRING, content STRING").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at, numbers, paths, contents = [], [], [], []
            for i, text in enumerate(rows.column(1).to_pylist()):
                cut = [] if text is None else cut_sections(text)
                at += [i] * len(cut)
                numbers += range(len(cut))
                paths += [p for p, _ in cut]
                contents += [c for _, c in cut]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, pa.int32()),
                 pa.array(paths, pa.string()), pa.array(contents, pa.string())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


#: Coarse to fine; the last cuts anywhere.
SEPARATORS = ("\n\n", "\n", " ", "")
Span = tuple[int, int]


def _bounds(text: str, span: Span, sep: str) -> list[Span]:
    """The pieces of a span, each but the first beginning with the separator."""
    a, b = span
    cuts, at = [a], text.find(sep, a, b)
    while at >= 0:
        if at > a:
            cuts.append(at)
        at = text.find(sep, at + len(sep), b)
    return list(zip(cuts, [*cuts[1:], b]))


def _merged(pieces: list[Span], size: int, overlap: int) -> list[Span]:
    """Neighbouring pieces joined up to ``size``; what the next one takes over is at most ``overlap`` long."""
    out: list[Span] = []
    first = 0
    for i, (start, end) in enumerate(pieces):
        if i > first and end - pieces[first][0] > size:
            out.append((pieces[first][0], start))
            while first < i and (start - pieces[first][0] > overlap or end - pieces[first][0] > size):
                first += 1
    if pieces:
        out.append((pieces[first][0], pieces[-1][1]))
    return out


def _anywhere(span: Span, size: int, overlap: int) -> list[Span]:
    """``_merged`` over single characters."""
    a, b = span
    out = []
    while b - a > size:
        out.append((a, a + size))
        a += size - min(overlap, size - 1)
    return [*out, (a, b)]


def _level(text: str, span: Span, level: int, size: int, overlap: int) -> list[Span]:
    """Cut a span at the coarsest separator in it. Pieces that fit are merged among themselves; one that
    does not is cut at the finer separators, and its parts are merged there."""
    level = next(i for i in range(level, len(SEPARATORS)) if text.find(SEPARATORS[i], *span) >= 0)
    if not SEPARATORS[level]:
        return _anywhere(span, size, overlap)
    out: list[Span] = []
    fitting: list[Span] = []
    for piece in _bounds(text, span, SEPARATORS[level]):
        if piece[1] - piece[0] < size:
            fitting.append(piece)
            continue
        out += _merged(fitting, size, overlap) + _level(text, piece, level + 1, size, overlap)
        fitting = []
    return out + _merged(fitting, size, overlap)


def merge_pieces(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of at most ``size`` characters, every level of separators merged on its own."""
    spans = _level(text, (0, len(text)), 0, size, overlap) if text else []
    return [c for c in (text[a:b].strip() for a, b in spans) if c]


#: Characters whose chunks a Python worker holds before it gives them back.
HELD_CHARS = 1_000_000


def cut_texts(batches: Iterator[pa.Array], size: int, overlap: int) -> Iterator[pa.Array]:
    """Chunks of the texts of every batch. One text at a time is a Python string, whatever the batch holds."""
    kind = pa.list_(pa.string())
    for texts in batches:
        found: list[list[str]] = []
        held = 0
        for x in texts:
            text = x.as_py() or ""
            found.append(merge_pieces(text, size, overlap))
            held += len(text)
            if held >= HELD_CHARS:
                yield pa.array(found, kind)
                found, held = [], 0
        if found:
            yield pa.array(found, kind)


def recursive_chunk_array(size: int = P.CHUNK_SIZE, overlap: int = P.CHUNK_OVERLAP):
    """Column function: separator-aware chunks of a text. Only texts longer than ``size`` go to Python."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return cut_texts(batches, size, overlap)

    def chunks(c) -> Column:
        text = F.col(c) if isinstance(c, str) else c
        whole = X.strip(text)
        long = F.length(text) > size
        return (F.when(long, cut(F.when(long, text)))
                .when(F.length(whole) > 0, F.array(whole)).otherwise(F.array().cast("array<string>")))

    return chunks


def recursive_chunks(docs: DataFrame, size: int = P.CHUNK_SIZE,
                     overlap: int = P.CHUNK_OVERLAP) -> DataFrame:
    cut = recursive_chunk_array(size, overlap)
    keys = [c for c in docs.columns if c != "text"]
    return docs.select(*keys, F.posexplode(cut("text")).alias("chunk_idx", "text"))


def is_toc(path: Column, text: Column) -> Column:
    return path.contains(P.TOC_PATH_MARK) | text.contains(P.TOC_TEXT_MARK)


def enrich(path: Column, content: Column) -> Column:
    return F.concat(F.lit("【章节】: "), F.coalesce(path, F.lit(P.DEFAULT_PATH)), F.lit(" | 【"),
                    X.clause_number(content), F.lit("】\n"), content)


def build_chunks(pieces: DataFrame) -> DataFrame:
    """(doc_id, chunk_idx, path, text) -> kept and enriched chunks.

    Order matters: table-of-contents test on the stripped text, then control
    characters, then the length test.
    """
    kept = (pieces.withColumn("text", X.strip(F.col("text")))
            .filter(~is_toc(F.coalesce("path", F.lit("")), F.col("text")))
            .withColumn("text", X.drop_control_chars(F.col("text")))
            .filter(F.length("text") >= P.MIN_CHUNK_CHARS))
    return kept.select("doc_id", "chunk_idx", F.coalesce("path", F.lit(P.DEFAULT_PATH)).alias("path"),
                       X.clause_number(F.col("text")).alias("clause"),
                       enrich(F.col("path"), F.col("text")).alias("text"))


def chunk_documents(docs: DataFrame) -> DataFrame:
    """Markdown documents -> enriched chunks: sections, recursive cut, filter, enrich."""
    cut = recursive_chunk_array()
    pieces = (sections(docs)
              .select("doc_id", "section_no", "path", F.posexplode(cut("content"))
                      .alias("piece_no", "text"))
              .withColumn("chunk_idx", F.struct("section_no", "piece_no")))
    return build_chunks(pieces).select(
        "doc_id", F.col("chunk_idx.section_no").alias("section_no"),
        F.col("chunk_idx.piece_no").alias("piece_no"), "path", "clause", "text")


def chunk_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id) left join chunk counts; 0 means still processing."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    return (docs.join(n, docs["id"] == n["doc_id"], "left")
            .select(docs["*"], F.coalesce("chunk_count", F.lit(0)).cast("bigint").alias("chunk_count")))


def write_back(chunks: DataFrame) -> DataFrame:
    """Per document: chunk_count and the ordered array of its chunk texts."""
    return (chunks.groupBy("doc_id")
            .agg(F.count("*").alias("chunk_count"),
                 F.sort_array(F.collect_list(F.struct("chunk_idx", "text"))).alias("cs"))
            .select("doc_id", "chunk_count",
                    F.transform("cs", lambda c: c["text"]).alias("parsed_content")))
