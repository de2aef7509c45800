"""Token counts through a digest cache, and a word cache around the tokenizers library."""

from __future__ import annotations

import functools
import hashlib
import json
import re
from importlib.metadata import version

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corestrata.llm.bpe import PairTable, merge_words
from corestrata.llm.common import batches, bounded_batches, path_exists, scratch, spool, texts, unspool
from corestrata.llm.exact import BROADCAST_BYTES, one_of_each, only, without

#: Words that one Python worker remembers, in two halves; beyond, it forgets the older one.
REMEMBERED = 700_000
#: The same where only counts are wanted, next to shuffles that need the memory.
COUNTED = 200_000
#: Bytes of texts that are split at a time, about: their words take many times as much.
SPLIT_BYTES = 4 << 20
#: Longer words are encoded each time.
LONGEST = 64
_ENDS = frozenset(".!?;:")
#: Characters of Latin-1 alone: their lower case and composition are the same everywhere.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]{1,100}").fullmatch
_STOPS, _APART = r"([A-Za-z0-9À-ÖØ-öø-ÿ])([!-/:-@\[-`{-~]+)([ \n])", r"\1 \2\3"


class WordCache:
    """Ids of whole texts, word by word, each distinct word encoded once.

    Sound only for a tokenizer whose white space is dropped and whose matches never cross it: what lies between
    blanks, tabs, line feeds and carriage returns is then encoded as it would be within the text, added tokens
    included, for these hold no white space either. __init__ refuses others. A run of punctuation between a letter
    or digit and white space is a match of its own and so counts as a word, in texts without added tokens. Words of Latin letters alone are lowered
    and merged in matrices, if the tokenizer lowers letters and marks the ends of words; the library encodes the rest.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.remembered = remembered
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        for a, b in (("of the", ("of", "the")), ("x\n'll 9.!", ("x", "'ll", "9", ".!"))):
            if self._encode([a])[0] != b"".join(self._encode(list(b))):
                raise ValueError(f"{path}: white space is part of its tokens")
        if any(re.search(r"\s", t.content) or t.lstrip or t.rstrip or t.single_word for t in self.library.get_added_tokens_decoder().values()):
            raise ValueError(f"{path}: an added token looks at white space")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.letters = _letter_merges(json.loads(self.library.to_str()))

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _fill(self, missing: list[str], into: dict[str, bytes]) -> None:
        plain = [w for w in missing if _LETTERS(w)] if self.letters else []
        if plain:
            into.update(zip(plain, merge_words([w.lower().encode() for w in plain], *self.letters), strict=True))
            missing = [w for w in missing if w not in into]
        for i in range(0, len(missing), 20_000):
            part = missing[i : i + 20_000]
            into.update(zip(part, self._encode(part), strict=True))

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words as little-endian unsigned 32-bit numbers. Words that were met since the half before last are remembered."""
        if len(self.known) > self.remembered // 2:
            self.known, self.older = {"": b""}, self.known
        out = list(map(self.known.get, words))
        missing = [w for w, ids in zip(words, out, strict=True) if ids is None]
        if not missing:
            return out
        again = {w: ids for w in missing if (ids := self.older.get(w)) is not None}
        self.known.update(again)
        missing = [w for w in missing if w not in again]
        self._fill([w for w in missing if len(w) <= LONGEST], self.known)
        once: dict[str, bytes] = {}
        self._fill([w for w in missing if len(w) > LONGEST], once)
        return [ids if ids is not None else self.known[w] if w in self.known else once[w] for w, ids in zip(words, out, strict=True)]

    def _coded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a column of texts: each word's number, where each text's words begin and end, and by number the words' ids: how many, where, and all of them. Words are split and told apart in Arrow; only distinct ones become Python strings."""
        column = pc.fill_null(column.cast(pa.string()), "")
        apart = pc.replace_substring_regex(column, _STOPS, _APART)
        for t in self.added:
            apart = pc.if_else(pc.match_substring(column, t), column, apart)
        for c in "\n\t\r":
            apart = pc.replace_substring(apart, c, " ")
        lists = pc.split_pattern(apart, " ")
        words = lists.values.dictionary_encode()
        ids = self._ids_of(words.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return words.indices.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), size, np.cumsum(size) - size, np.frombuffer(b"".join(ids), "<u4")

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a column; null counts as empty."""
        out = [np.empty(0, np.int64)]
        for part in self._parts(column):
            word, edges, size, _, _ = self._coded(part)
            ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size[word])))
            out.append(ends[edges[1:]] - ends[edges[:-1]])
        return np.concatenate(out)

    @staticmethod
    def _parts(column: pa.Array):
        """Slices of about SPLIT_BYTES, of one text at least."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SPLIT_BYTES, "right")))
            yield column.slice(at, end - at)
            at = end

    def ids(self, column: pa.Array) -> list[np.ndarray]:
        """Each text's ids as unsigned 32-bit numbers."""
        out: list[np.ndarray] = []
        for part in self._parts(column):
            word, edges, size, start, flat = self._coded(part)
            n = size[word]
            ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
            whole = flat[np.repeat(start[word] - ends[:-1], n) + np.arange(ends[-1])]
            out += [whole[a:b] for a, b in zip(ends[edges[:-1]].tolist(), ends[edges[1:]].tolist(), strict=True)]
        return out

    def sentence_ends(self) -> np.ndarray:
        """By id, whether a token ends with a mark that ends sentences or clauses."""
        vocab = self.library.get_vocab()
        end = getattr(self.library.model, "end_of_word_suffix", None) or ""
        out = np.zeros(max(vocab.values()) + 1, bool)
        out[[i for t, i in vocab.items() if t.removesuffix(end)[-1:] in _ENDS]] = True
        return out


def _letter_merges(settings: dict):
    """Ids of bytes, merges, and ids of last bytes, for words of Latin letters; None unless the settings are those that allow it: letters lowered, runs of letters matched whole, bytes as symbols, ends of words marked, merges in the order of their ids."""
    model, parts = settings["model"], (settings["pre_tokenizer"] or {}).get("pretokenizers", [])
    normal = [x["type"] for x in (settings["normalizer"] or {}).get("normalizers", [])]
    end = model.get("end_of_word_suffix")
    if model["type"] != "BPE" or not end or model.get("dropout") or model.get("ignore_merges") or normal != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in parts] != ["Split", "ByteLevel"] or r"|[\p{L}]+|" not in parts[0]["pattern"].get("Regex", "") or parts[1].get("add_prefix_space"):
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    hidden = iter(range(256, 512))
    symbol = [chr(b if b in shown else next(hidden)) for b in range(256)]
    vocab = model["vocab"]
    pairs, least = {}, -1
    for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
        if (new := vocab[a + b]) <= least:
            return None
        pairs[vocab[a], vocab[b]] = least = new
    return np.array([vocab[c] for c in symbol], np.int32), PairTable(pairs), np.array([vocab[c + end] for c in symbol], np.int32)


def tokenizer_digest(path: str) -> str:
    """Of the file and the library that reads it."""
    name = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"\0{name}\0{version(name)}".encode()).hexdigest()


_COUNTS = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])


@functools.lru_cache(2)
def word_cache(path: str, remembered: int = REMEMBERED) -> WordCache:
    """One for all tasks of a Python worker."""
    return WordCache(path, remembered)


@functools.lru_cache(2)
def _counter(path: str):
    """A function from a column of texts to token counts; one for all tasks of a Python worker."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda column: [len(x) for x in model.encode(texts(column), num_threads=1)]
    try:
        cache = word_cache(path, COUNTED)
    except ValueError:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_padding()
        library.no_truncation()
        return lambda column: [len(x.ids) for x in library.encode_batch_fast(texts(column), add_special_tokens=False)]
    return cache.counts


def _count_misses(path: str):
    def run(source):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = _counter(path)
        yield from batches(source, lambda b: [b.column(0), count(b.column(1))], _COUNTS)

    return run


def normalised(text: Column, path: str) -> Column:
    """What a tokenizer's counts depend on: for one that drops white space the text without blanks, tabs and ends of lines around it; else the text itself. Null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return F.btrim(whole, F.lit(" \t\n\r")) if drops_blanks(path) else whole


@functools.cache
def drops_blanks(path: str) -> bool:
    if path.endswith(".model"):
        return False
    try:
        word_cache(path, COUNTED)
    except ValueError:
        return False
    return True


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, content_sha256 for each row of docs, whole texts of any length, without special tokens.

    The cache is a table (tokenizer, digest, n_tokens) under cache_path, partitioned by tokenizer: digests of
    normalised contents found there are not encoded; of the others each distinct content is encoded once and
    appended. tokenizer is the digest of the vocabulary file and the library's version, so a new version never
    meets old counts. Digests alone are grouped and joined; a content that one row has goes to the tokenizer from
    the scan, and only those of several rows are shuffled, to be encoded once.

    cache_path keeps the cache between runs; without it spark.corestrata.token.cache does, where set; else a new
    one is written to the shared folder. Null counts as the empty text, of 0 tokens; null doc_ids stay null; equal
    contents share one entry, whichever of them is encoded; repeated rows each give a row; an empty table gives
    none. Further columns are not read, whatever they are called. The file at tokenizer_path must be readable at
    that path on every executor.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    content = normalised(F.col(f"`{text_col}`"), tokenizer_path)
    digest = F.unhex(F.sha2(F.encode(content, "UTF-8"), 256))
    rows = spool(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("long").alias("n_bytes"), digest.alias("digest")), "digests")
    tokenizer = tokenizer_digest(tokenizer_path)
    cache_path = cache_path or spark.conf.get("spark.corestrata.token.cache", None) or scratch(spark, "token-cache")
    at = f"{cache_path}/tokenizer={tokenizer}"
    stored = lambda: spark.read.schema("digest binary, n_tokens long").parquet(at)
    every = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    there = path_exists(spark, at)
    new = spool(every.join(stored().select("digest"), "digest", "left_anti") if there else every, "misses")
    if not there or not new.isEmpty():
        named = docs.select(digest.alias("_digest"), content.alias("_content"))
        if there:
            named = only(named, new.select(F.col("digest").alias("_gone")), F.col("_digest"), broadcast_bytes).select("_own.*")
        often = spool(new.where("n > 1").select(F.col("digest").alias("_gone")), "often")
        once = without(named, often, F.col("_digest"), broadcast_bytes).unionByName(one_of_each(named, often, F.col("_digest"), broadcast_bytes))
        once.select("_digest", "_content").mapInArrow(_count_misses(tokenizer_path), "digest binary, n_tokens long").write.mode("append").parquet(at)
        unspool(often)
    # Two writers may have appended the same digest. Written first, so that adaptive execution may split the join at a content that many rows have.
    counts = spool(stored().join(every.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    unspool(new)
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("digest")).alias("content_sha256"))
