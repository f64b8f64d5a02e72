"""Word index and fixed-length id sequences for the sequence model.

Ids: 0 pads, 1 is the out-of-vocabulary word, the words get
2, 3, ... by falling frequency (ties to the smaller word), all of them or, with
``num_words``, the ``num_words - 2`` most frequent. Sequences keep the
first ``maxlen`` ids of the whole text and are padded with 0 after it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from .lineage import lookup, write_table
from .ranking import global_rank

PAD_ID = 0
OOV_ID = 1


@dataclass
class WordIndex:
    table: DataFrame          # word, id
    num_words: int            # ids run from 0 to num_words - 1
    n_words: int


def fit_word_index(train: DataFrame, text: str = "clean_light", num_words: int | None = None) -> WordIndex:
    """Rank words by frequency (exact distributed rank, ties to the smaller
    word): ids 2, 3, ... Every word is kept unless ``num_words`` sets a limit."""
    counts = (train.select(F.explode(words(text)).alias("word"))
              .groupBy("word").agg(F.count(F.lit(1)).alias("count")))
    top = global_rank(counts, [F.desc("count"), F.asc("word")],
                      k=None if num_words is None else num_words - 2)
    table = write_table(top.select("word", "count", (F.col("rank") + 2).cast("int").alias("id")),
                        "word-index")
    n = table.count()
    return WordIndex(table, n + 2 if num_words is None else num_words, n)


def encode_sequence(docs: DataFrame, index: WordIndex, text: str = "clean_light",
                    maxlen: int = 150, key: str = "doc_id", keep: list[str] | tuple = (),
                    oov: str = "index") -> DataFrame:
    """``(key, *keep, ids array<int>)`` of length ``maxlen``.

    Words are looked up (the frequent ones where they are, see ``lookup``); unknown
    words become ``OOV_ID`` (``oov='index'``) or are dropped (``oov='drop'``). Where
    none is dropped every word gives an id, so those after the first ``maxlen``
    cannot enter the sequence and stay out. Ids are gathered back in word order per document, then
    truncated / padded after the end.
    """
    keep = list(keep)
    met = F.slice(words(text), 1, maxlen) if oov == "index" else words(text)
    pos = docs.select(key, *keep, F.posexplode_outer(met).alias("pos", "word"))
    # the more frequent a word, the smaller its id
    j = lookup(pos, index.table.select("word", "id"), "word", index.n_words, -F.col("id"))
    if oov == "index":
        wid = F.when(F.col("pos").isNotNull(), F.coalesce(F.col("id"), F.lit(OOV_ID)))
    else:
        wid = F.col("id")
    item = F.when(wid.isNotNull(), F.struct(F.col("pos"), wid.alias("id")))
    g = j.groupBy(key, *keep).agg(F.array_sort(F.collect_list(item)).alias("items"))
    ids = F.transform(F.col("items"), lambda x: x["id"])
    return g.select(key, *keep, pad_post(ids, maxlen).alias("ids"))


def pad_post(ids, maxlen: int):
    """First ``maxlen`` ids, then zeros up to ``maxlen``."""
    head = F.slice(ids, 1, maxlen)
    fill = F.array_repeat(F.lit(PAD_ID), F.greatest(F.lit(maxlen) - F.size(head), F.lit(0)))
    return F.concat(head, fill)
