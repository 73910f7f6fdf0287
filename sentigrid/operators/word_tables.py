"""Joins of a corpus's words with word tables of any size: stop lists, stem tables.

Words are rows (key, position, token). A word that makes up a large share of all words would put them into one task;
those words are few by arithmetic, at most FREQUENT, so their part of the table is broadcast. All other words
meet the table in a shuffle by word, in which no word has more than 1/FREQUENT of the rows.

A table of at most IN_ROW rows goes to the tasks as a whole, and the words of a text are looked up where they are: no rows per word,
no shuffle. Texts whose key repeats are one text, as before; these few are put together by rows.

A larger stem table meets the different words of blocks of texts: a block is some megabytes, its texts hold numbers into its list of
words, and of the words each is one row a block, however often it stands there. No word has more rows than there are blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentigrid.functions import text as tx
from sentigrid.functions.stemming import stem_tokens
from sentigrid.session import stage_table

FREQUENT = 10_000
# rows of a table that are broadcast at most
BROADCAST_ROWS = 200_000
# rows of a table that every task holds at most
IN_ROW = 200_000
# bytes of words in a block of texts, which a task holds at a time
BLOCK_BYTES = 16 << 20


def repeated_keys(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key is theirs alone, and those whose key repeats, None if there are none."""
    again = df.groupBy(F.col(id_col).alias("_again")).agg(F.count("*").alias("n")).filter("n > 1").select("_again")
    again = stage_table(again, "repeated-keys")
    if again.isEmpty():
        return df, None
    same = df[id_col].eqNullSafe(again["_again"])
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


def _small(table: DataFrame) -> list | None:
    """The rows of a table of at most IN_ROW rows, else None."""
    rows = table.limit(IN_ROW + 1).collect()
    return rows if len(rows) <= IN_ROW else None


def _lists(lists: pa.Array, change: Callable[[pa.Array], tuple[pa.Array, np.ndarray]]) -> pa.Array:
    """Lists of words after `change`, which gives the words and which of them stay; a null list becomes an empty one."""
    lists = lists.cast(pa.list_(pa.string()))
    words, kept = change(lists.flatten())
    left = np.concatenate([[0], np.cumsum(kept)])[_ends(lists)]
    return pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), words.filter(pa.array(kept)))


def _without(tokens: Column, listed: list[str], punctuation: bool) -> Column:
    marks = tx.ASCII_PUNCTUATION
    pieces = {marks[a:b] for a in range(len(marks) + 1) for b in range(a, len(marks) + 1)} if punctuation else set()
    gone = sorted({*listed, *pieces})

    @F.arrow_udf("array<string>")
    def drop(lists: pa.Array) -> pa.Array:
        def change(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
            out = pc.is_in(words, value_set=pa.array(gone, pa.string()))
            if punctuation:  # a null word is dropped with the pieces
                out = pc.or_(out, words.is_null())
            return words, ~out.to_numpy(zero_copy_only=False)

        return _lists(lists, change)

    return drop(tokens)


def _replaced(tokens: Column, stems: dict[str, str]) -> Column:
    @F.arrow_udf("array<string>")
    def put(lists: pa.Array) -> pa.Array:
        def change(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
            coded = words.dictionary_encode()
            stemmed = pa.array([stems.get(w, w) for w in coded.dictionary.to_pylist()], pa.string())
            return stemmed.take(coded.indices), np.ones(len(words), dtype=bool)

        return _lists(lists, change)

    return put(tokens)


def word_rows(df: DataFrame, tokens: Column, id_col: str = "doc_id") -> DataFrame:
    """(key, position, token); a row without tokens keeps one row of nulls."""
    return df.select(id_col, F.posexplode_outer(tokens).alias("position", "token"))


def meet(rows: DataFrame, table: DataFrame, key: str, how: str) -> DataFrame:
    """`rows` joined with `table` on `key` ('left', 'inner', 'left_semi' or 'left_anti'), frequent keys apart.

    `rows` is read three times, so it should be staged. Null keys meet nothing.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    counts = stage_table(counts, "key-counts")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    often = stage_table(counts.filter(F.col("_n") * FREQUENT >= total).select(key), "frequent")
    known = stage_table(table.join(F.broadcast(often), key, "left_semi"), "frequent-rows")
    if known.count() > BROADCAST_ROWS:  # many rows for one key: left to the shuffle and its splitting of skewed keys
        return rows.join(table, key, how)
    marked = rows.join(F.broadcast(often.withColumn("_often", F.lit(True))), key, "left")
    near = marked.filter("_often").drop("_often").join(F.broadcast(known), key, how)
    far = marked.filter("_often IS NULL").drop("_often").join(table, key, how)
    return near.unionByName(far)


def reassemble(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(key, tokens) of (key, position, token) rows, in order of position; one group is one text."""
    listed = F.array_sort(F.collect_list(F.when(F.col("position").isNotNull(), F.struct("position", "token"))))
    return rows.groupBy(id_col).agg(F.transform(listed, lambda x: x["token"]).alias("tokens"))


def remove_listed(df: DataFrame, tokens: Column, table: DataFrame, id_col: str = "doc_id",
                  punctuation: bool = True) -> DataFrame:
    """(key, tokens) without the words of a (term) table of any size, as `remove_stopwords` does for a list.

    With `punctuation` pieces of the ASCII punctuation string go too. A text that loses all its words stays, with none.
    The key has to be unique.
    """
    terms = stage_table(table.select(F.col("term").alias("token")).filter("token IS NOT NULL").distinct(), "listed-words")
    listed = _small(terms)
    if listed is None:
        return _remove_by_rows(df, tokens, terms, id_col, punctuation)
    once, again = repeated_keys(df, id_col)
    kept = once.select(id_col, _without(tokens, [r[0] for r in listed], punctuation).alias("tokens"))
    return kept if again is None else kept.unionByName(_remove_by_rows(again, tokens, terms, id_col, punctuation))


def _remove_by_rows(df: DataFrame, tokens: Column, terms: DataFrame, id_col: str, punctuation: bool) -> DataFrame:
    rows = stage_table(word_rows(df, tokens, id_col), "words")
    kept = meet(rows, terms, "token", "left_anti")
    if punctuation:
        piece = F.instr(F.lit(tx.ASCII_PUNCTUATION), F.col("token")) > 0
        kept = kept.withColumn("position", F.when(~piece, F.col("position")))
    # the null row keeps a text without words
    whole = kept.select(id_col, "position", "token").unionByName(
        rows.select(id_col).distinct().select(id_col, F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("token")))
    return reassemble(whole, id_col)


def stem_dictionary(words: DataFrame) -> DataFrame:
    """(token, stem) of the different tokens of a column `token`, each stemmed once."""
    tokens = words.select("token").filter(F.col("token").isNotNull()).distinct()
    return tokens.select("token", F.get(stem_tokens(F.array("token")), F.lit(0)).alias("stem"))


def stem_by_table(df: DataFrame, tokens: Column, table: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(key, tokens) with every token replaced by its stem.

    `table` is the user's (token, stem) table of any size; a token it does not list stays as it is, of several stems
    the least counts. Without a table the corpus's own dictionary is built, by the rules of `functions.stemming`.
    The key has to be unique.
    """
    if table is None:
        return _stem_by_blocks(df, tokens, None, id_col)
    stems = stage_table(table.filter("token IS NOT NULL").groupBy("token").agg(F.min("stem").alias("stem")), "stem-table")
    listed = _small(stems)
    if listed is None:
        return _stem_by_blocks(df, tokens, stems, id_col)
    once, again = repeated_keys(df, id_col)
    stemmed = once.select(id_col, _replaced(tokens, {r.token: r.stem for r in listed if r.stem is not None}).alias("tokens"))
    return stemmed if again is None else stemmed.unionByName(_stem_by_blocks(again, tokens, stems, id_col))


def _stem_by_blocks(df: DataFrame, tokens: Column, stems: DataFrame | None, id_col: str) -> DataFrame:
    coded = stage_table(word_blocks(df, tokens, id_col), "blocks")
    words = coded.filter(F.col("words").isNotNull()).select(F.col("block").alias("of"), F.posexplode("words").alias("position", "token"))
    if stems is None:
        stems = stage_table(stem_dictionary(words), "stems")
    found = words.join(stems.filter("stem IS NOT NULL"), "token").select("of", "position", "stem")
    key = coded.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, key), T.StructField("tokens", T.ArrayType(T.StringType()))])
    stemmed = coded.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(_stemmed_block, schema)
    once, again = repeated_keys(coded.select(id_col), id_col)
    if again is None:
        return stemmed
    stemmed = stage_table(stemmed, "stemmed")
    again = again.distinct().withColumnRenamed(id_col, "_again")
    same = stemmed[id_col].eqNullSafe(again["_again"])
    parts = word_rows(stemmed.join(again, same, "left_semi"), F.col("tokens"), id_col)
    return stemmed.join(again, same, "left_anti").unionByName(reassemble(parts, id_col))


def word_blocks(df: DataFrame, tokens: Column, id_col: str) -> DataFrame:
    """(block, key, codes, words): the texts in blocks, their words as numbers into the block's different words.

    These stand in the first row of a block, the other rows have null there. Null tokens become none, a null word a null number.
    A block's number depends on how the table was read, so the result has to be staged.
    """
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField(id_col, df.schema[id_col].dataType),
                           T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("words", T.ArrayType(T.StringType()))])
    most = BLOCK_BYTES

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before, current, held = TaskContext.get().partitionId() << 32, 0, 0, []
        for batch in batches:
            ends = before + np.cumsum(_list_bytes(batch.column(1)))
            blocks = np.concatenate([[before], ends[:-1]])[:len(ends)] // most
            for block in np.unique(blocks).tolist():
                if held and block != current:
                    yield _coded_block(first + current, held, schema.names)
                    held = []
                start, stop = np.searchsorted(blocks, [block, block + 1]).tolist()
                current, held = block, [*held, batch.slice(start, stop - start)]
            before = int(ends[-1]) if len(ends) else before
        if held:
            yield _coded_block(first + current, held, schema.names)

    return df.select(id_col, tokens.alias("tokens")).mapInArrow(number, schema)


def _ends(lists: pa.Array) -> np.ndarray:
    """Where lists begin and end among their words; a null list has none."""
    return np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])


def _list_bytes(lists: pa.Array) -> np.ndarray:
    """Bytes of each list of words, with some for every word and list."""
    sizes = pc.fill_null(pc.binary_length(lists.flatten()), 0).to_numpy(zero_copy_only=False) + 4
    return np.diff(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[_ends(lists)]) + 8


def _coded_block(block: int, held: list[pa.RecordBatch], names: list[str]) -> pa.RecordBatch:
    keys = pa.concat_arrays([b.column(0) for b in held])
    lists = pa.concat_arrays([b.column(1).cast(pa.list_(pa.string())) for b in held])
    coded = lists.flatten().dictionary_encode()
    codes = pa.ListArray.from_arrays(pa.array(_ends(lists), pa.int32()), coded.indices)
    only = np.full(len(keys) + 1, len(coded.dictionary), np.int32)
    only[0] = 0
    words = pa.ListArray.from_arrays(pa.array(only), coded.dictionary, mask=pa.array(np.arange(len(keys)) > 0))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block)), keys, codes, words], names=names)


def _stemmed_block(texts: pa.Table, found: pa.Table) -> pa.Table:
    """The rows of a block with their words, in place of those that were found the stem."""
    _, keys, codes, words = (pa.concat_arrays(c.chunks) for c in texts.itercolumns())
    words = words.flatten()
    at = np.arange(len(words))
    at[found["position"].to_numpy()] = len(words) + np.arange(len(found))
    both = pa.concat_arrays([words, *(c.cast(words.type) for c in found["stem"].chunks)])
    flat = both.take(pa.array(at)).take(codes.flatten())
    lists = pa.ListArray.from_arrays(pa.array(_ends(codes), pa.int32()), flat)
    return pa.Table.from_arrays([keys, lists], names=[texts.column_names[1], "tokens"])
