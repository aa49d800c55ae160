"""BPE encoding and decoding by speculation: greedy tokens, checked pair by pair, and exact merging where a check fails.

For vocabularies whose words are cut at white space and end in a suffix of their own. A text is cut at ASCII white space,
which no rule of such a vocabulary reaches across; each piece not seen before in the worker goes through the
vocabulary's normaliser and word pattern, and its words then
1. get tokens by greedy longest match in a trie of all tokens that merging can reach,
2. have every adjacent pair of tokens tested: two tokens stand side by side in an exact encoding if and only if no merge
   crosses their border while they grow, and a word is right if and only if all its pairs are (merges inside tokens go the
   same way with and without neighbours until a first one crosses a border, and that one sees one border only),
3. are merged exactly, lowest rank first, if a pair fails.
Steps 1 and 2 run over all new words of a chunk at once in numpy.

Nothing is shuffled: each row is encoded where it is read. Memory is bounded by chunks of about a quarter of a megabyte
(a longer text is cut into such runs, at white space) and by a cache of pieces that is emptied at CACHE bytes; one text's ids
and one piece without white space are held whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import CHUNK, chunks

CACHE = 64 << 20  # bytes of pieces and ids that a worker remembers
NEVER = np.int64(1) << 40
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def default_vocabulary() -> str:
    """Path of the public word-end vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Codec:
    """Tables of one vocabulary file and the encoder over them."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        model, suffix = parsed["model"], parsed["model"].get("end_of_word_suffix")
        unlike = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or not suffix or unlike or parsed["decoder"] or parsed["post_processor"]:
            raise ValueError(f"not a plain vocabulary with word ends: {unlike or model['type']}")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in parsed["added_tokens"]):
            raise ValueError("added tokens are looked for in raw texts only")
        library = Tokenizer.from_str(spec)
        self.normalise, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.added = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        vocab: dict[str, int] = model["vocab"]
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self._symbols(vocab, suffix)
        self._merges(vocab, [m.split(" ") if isinstance(m, str) else m for m in model["merges"]])
        self._trie()
        self.seen: dict[bytes, bytes] = {}  # ids of pieces of text
        self.held = 0

    def _symbols(self, vocab: dict[str, int], suffix: str) -> None:
        """Symbols are 0 to 255 for characters inside a word and 256 to 511 for the last one."""
        from tokenizers.pre_tokenizers import ByteLevel

        chars = sorted(ByteLevel.alphabet())
        if any(c + end not in vocab for c in chars for end in ("", suffix)):
            raise ValueError("the vocabulary lacks bytes")
        self.symbol = np.full(max(map(ord, chars)) + 1, -1, np.int64)
        self.symbol[[ord(c) for c in chars]] = np.arange(256)
        self.base = np.array([vocab[c + end] for end in ("", suffix) for c in chars], np.int64)

    def _merges(self, vocab: dict[str, int], merges: list[list[str]]) -> None:
        n = self.size
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if self.rank[z] >= 0 or rank <= max(self.rank[x], self.rank[y]):
                raise ValueError("merges must name a new token each, after its parts")
            self.pairs[x * n + y] = rank, z
            self.rank[z], self.left[z], self.right[z] = rank, x, y
        codes = np.array(sorted(self.pairs), np.int64)
        self.codes, self.code_rank = np.append(codes, NEVER << 20), np.append([self.pairs[c][0] for c in codes.tolist()], NEVER).astype(np.int64)
        self.code_token = np.append([self.pairs[c][1] for c in codes.tolist()], -1).astype(np.int64)

    def _trie(self) -> None:
        """Edges node * 512 + symbol in order, their targets, and each node's token; only tokens that merging their own symbols gives."""
        at = {t: s for s, t in enumerate(self.base.tolist())}
        spelled = {t: (s,) for t, s in at.items()}
        edges: dict[int, int] = {}
        token = [-1]
        for t in [*at, *np.argsort(self.rank, kind="stable")[(self.rank < 0).sum():].tolist()]:
            if t not in spelled:
                spelled[t] = spelled[int(self.left[t])] + spelled[int(self.right[t])]
                if self.merged(self.base[list(spelled[t])].tolist()) != [t]:
                    continue
            node = 0
            for s in spelled[t]:
                nxt = edges.get(node * 512 + s)
                if nxt is None:
                    nxt = edges[node * 512 + s] = len(token)
                    token.append(-1)
                node = nxt
            token[node] = t
        keys = np.array(sorted(edges), np.int64)
        self.edges, self.target = np.append(keys, NEVER), np.append([edges[k] for k in keys.tolist()], -1).astype(np.int64)
        self.token = np.array(token, np.int64)

    def merged(self, ids: list[int]) -> list[int]:
        """Exact encoding of one word's symbols: the pair of lowest rank, the leftmost of equals, is merged first."""
        n, pairs, size = len(ids), self.pairs, self.size
        ids, nxt, prev = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*pairs[c], i) for i in range(n - 1) if (c := ids[i] * size + ids[i + 1]) in pairs]
        heap = [(rank, i, z) for rank, z, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, z = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] < 0 or j >= n or pairs.get(ids[i] * size + ids[j]) != (rank, z):
                continue
            ids[i], ids[j] = z, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prev[k] = i
                if p := pairs.get(z * size + ids[k]):
                    heapq.heappush(heap, (p[0], i, p[1]))
            if (h := prev[i]) >= 0 and (p := pairs.get(ids[h] * size + z)):
                heapq.heappush(heap, (p[0], h, p[1]))
        return [t for t in ids if t >= 0]

    def merged_together(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact encodings of many short words at once, one merge a word and round: tokens and their owners, in order of owners."""
        done, none = [], np.int64(len(self.pairs))
        while len(ids):
            code = ids[:-1] * self.size + ids[1:]
            at = np.searchsorted(self.codes, code)
            here = (self.codes[at] == code) & (owner[1:] == owner[:-1])
            order = np.append(np.where(here, self.code_rank[at], none), none) * len(ids) + np.arange(len(ids))
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(order, first)
            goes = least < none * len(ids)
            pos = least[goes] % len(ids)
            ids[pos] = self.code_token[at[pos]]
            stays, going = np.ones(len(ids), bool), np.repeat(goes, np.diff(np.append(first, len(ids))))
            stays[pos + 1] = False
            done.append((ids[~going], owner[~going]))
            ids, owner = ids[going & stays], owner[going & stays]
        ids, owner = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(owner, kind="stable")
        return ids[order], owner[order]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays apart when both are merged from symbols side by side.

        The border is followed back in time: of the token left and the token right of it the one made later is taken
        apart. A merge across the border happens if its rank is below that of the merge that uses up the left one, and not
        above that of the merge that uses up the right one (of equal ranks the leftmost goes first).
        """
        a, b, good, todo = a.copy(), b.copy(), np.ones(len(a), bool), np.arange(len(a))
        until_a, until_b = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(todo):
            code = a * self.size + b
            at = np.searchsorted(self.codes, code)
            across = np.where(self.codes[at] == code, self.code_rank[at], NEVER)
            crossed = (across < until_a) & (across <= until_b)
            good[todo[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & (np.maximum(ra, rb) >= 0)
            todo, a, b, ra, rb, until_a, until_b = todo[go], a[go], b[go], ra[go], rb[go], until_a[go], until_b[go]
            of_a = ra > rb
            until_a, until_b = np.where(of_a, ra, until_a), np.where(of_a, until_b, rb)
            a, b = np.where(of_a, self.right[a], a), np.where(of_a, b, self.left[b])
        return good

    def longest(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each position: the longest token that starts there and its length; ends: where the position's word ends."""
        best, length = np.full(len(symbols), -1, np.int64), np.ones(len(symbols), np.int64)
        at, node, depth = np.arange(len(symbols)), np.zeros(len(symbols), np.int64), 0
        while len(at):
            code = node * 512 + symbols[at + depth]
            edge = np.searchsorted(self.edges, code)
            hit = self.edges[edge] == code
            at, node = at[hit], self.target[edge[hit]]
            depth += 1
            token = self.token[node]
            made = token >= 0
            best[at[made]], length[at[made]] = token[made], depth
            more = at + depth < ends[at]
            at, node = at[more], node[more]
        return best, length

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in order, and how many each word has. Words consist of the characters that stand for bytes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        stops = np.cumsum(sizes)
        starts = stops - sizes
        symbols[stops - 1] += 256
        best, length = self.longest(symbols, np.repeat(stops, sizes))
        chosen = np.zeros(len(symbols), bool)
        at, stop = starts, stops
        while len(at):
            chosen[at] = True
            at = at + length[at]
            more = at < stop
            at, stop = at[more], stop[more]
        where = np.flatnonzero(chosen)
        tokens, owner = best[where], np.searchsorted(stops, where, "right")
        same = np.flatnonzero(owner[1:] == owner[:-1])
        wrong = np.unique(owner[same[~self.compatible(tokens[same], tokens[same + 1])]])
        if len(wrong):
            short = wrong[sizes[wrong] <= 64]
            inside = np.zeros(len(words), bool)
            inside[short] = True
            inside = np.repeat(inside, sizes)
            parts = [self.merged_together(self.base[symbols[inside]], np.repeat(np.arange(len(words)), sizes)[inside])] if len(short) else []
            for w in wrong[sizes[wrong] > 64].tolist():
                exact = np.array(self.merged(self.base[symbols[starts[w]:stops[w]]].tolist()), np.int64)
                parts.append((exact, np.full(len(exact), w)))
            right = np.isin(owner, wrong, invert=True)
            tokens, owner = (np.concatenate(x) for x in zip((tokens[right], owner[right]), *parts))
            order = np.argsort(owner, kind="stable")
            tokens, owner = tokens[order], owner[order]
        counts = np.bincount(owner, minlength=len(words))
        return tokens, counts

    def cuts(self, pieces: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of all pieces in order, and how many each piece has.

        Pieces without white space go through the vocabulary's rules joined by blanks, which none of them reaches across.
        """
        blank = [i for i, p in enumerate(pieces) if p.split() != [p]]
        if blank or not pieces:
            lists: list[list[str]] = [[]] * len(pieces)
            for i in blank:
                lists[i] = [w for w, _ in self.cut(self.normalise(pieces[i]))]
            rest = sorted(set(range(len(pieces))) - set(blank))
            words, counts = self.cuts([pieces[i] for i in rest]) if rest else ([], np.zeros(0, np.int64))
            ends = np.cumsum(counts)
            for i, a, b in zip(rest, (ends - counts).tolist(), ends.tolist()):
                lists[i] = words[a:b]
            return [w for x in lists for w in x], np.fromiter(map(len, lists), np.int64, len(lists))
        joined = self.normalise("\n".join(pieces))
        found = self.cut(joined)
        starts = np.cumsum(np.fromiter(map(len, joined.split(" ")), np.int64, len(pieces)) + 1)
        owner = np.searchsorted(starts, np.fromiter((at[0] for _, at in found), np.int64, len(found)), "right")
        return [w for w, _ in found], np.bincount(owner, minlength=len(pieces))

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each piece of text."""
        words, n_words = self.cuts(pieces)
        if not words:
            return [b""] * len(pieces)
        tokens, counts = self.words(words)
        bounds = 4 * np.append(0, np.cumsum(counts))[np.append(0, np.cumsum(n_words))]
        packed, bounds = tokens.astype("<u4").tobytes(), bounds.tolist()
        return [packed[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def learn(self, new: list[bytes]) -> None:
        """Remembers the ids of new pieces; marks of added tokens are cut out of them first."""
        texts = [p.decode() for p in new]
        marked = [i for i, t in enumerate(texts) if self.marks and self.marks.search(t)]
        for i in marked:
            parts = self.marks.split(texts[i])  # text and marks in turn
            ids = self.pieces(parts[::2])
            marks = [self.added[m].to_bytes(4, "little") for m in parts[1::2]] + [b""]
            self.seen[new[i]] = b"".join(x for pair in zip(ids, marks) for x in pair)
        plain = [i for i in range(len(new)) if i not in set(marked)] if marked else range(len(new))
        self.seen.update(zip([new[i] for i in plain], self.pieces([texts[i] for i in plain])))
        self.held += sum(len(p) + len(self.seen[p]) + 100 for p in new)

    def forget(self) -> None:
        if self.held > CACHE:
            self.seen.clear()
            self.held = 0

    def encode(self, texts: Iterable[bytes | None]) -> list[bytes]:
        """Packed ids of each text."""
        out = []
        for text in texts:
            runs = []
            a = 0
            while text and a < len(text):
                stop = _SPACE.search(text, a + CHUNK)
                b = stop.start() if stop else len(text)
                runs.append(self._run(text[a:b].split()))
                a = b
            out.append(b"".join(runs))
        return out

    def _run(self, pieces: list[bytes]) -> bytes:
        try:
            return b"".join([self.seen[p] for p in pieces])
        except KeyError:
            self.forget()
            self.learn([p for p in dict.fromkeys(pieces) if p not in self.seen])
            return b"".join([self.seen[p] for p in pieces])

    def prepare(self, texts: list[bytes | None]) -> None:
        """Learns the new pieces of many short texts at once."""
        self.forget()
        new = dict.fromkeys(p for t in texts if t and len(t) <= CHUNK for p in t.split() if p not in self.seen)
        if new:
            self.learn(list(new))


_codecs: dict[str, Codec] = {}  # of this worker, by digest of the vocabulary


def _codec(spec: bytes) -> Codec:
    key = hashlib.sha256(spec).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(spec.decode())
    return _codecs[key]


def _vocabulary(df: DataFrame, path: str | None):
    """The vocabulary file, read by the driver (some megabytes, whatever the data) and sent to the workers."""
    with open(path or default_vocabulary(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id, n_tokens, ids) of each row: ids are packed as little-endian unsigned 32-bit integers, as token files hold them.

    Nothing is added before, after or around a text. Null and empty texts, and those of white space alone, have no tokens.
    Rows keep their ids, null or repeated ones too; other columns, whatever their names, are not read. vocabulary: path of
    a file of the tokenizers library with word ends and without decoder; ValueError if it is of another kind.
    """
    spec = _vocabulary(docs, vocabulary)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = part.column("text").cast(pa.large_binary()).to_pylist()
                codec.prepare(texts)
                ids = codec.encode(texts)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """Adds `decoded`: the tokens' strings joined by one space, marks of added tokens included, as the library does without a decoder.

    ids_col holds packed ids, as of encode(). No ids give an empty text, null gives null; ids outside the vocabulary are left
    out. Other columns stay; one of the name decoded is replaced.
    """
    spec = _vocabulary(tokens, vocabulary)
    rest = [c for c in tokens.columns if c not in (ids_col, "decoded")]
    names = [f"c{i}" for i in range(len(rest))]
    rows = tokens.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names)], F.col(f"`{ids_col}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed = json.loads(spec.value)
        vocab = parsed["model"]["vocab"] | {t["content"]: t["id"] for t in parsed["added_tokens"]}
        strings: list[str | None] = [None] * (max(vocab.values()) + 1)
        for s, i in vocab.items():
            strings[i] = s
        known, strings = np.array([s is not None for s in strings]), pa.array(strings, pa.large_string())
        for batch in batches:
            for part in chunks(batch, "ids"):
                packed = part.column("ids")
                ids = [np.frombuffer(x, "<u4").astype(np.int64) for x in pc.fill_null(packed, b"").to_pylist()]
                ids = [x[(x < len(known)) & known[np.minimum(x, len(known) - 1)]] for x in ids]
                ends = np.append(0, np.cumsum([len(x) for x in ids]))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), strings.take(pa.array(np.concatenate(ids))))
                out = pc.if_else(pc.is_valid(packed), pc.binary_join(lists, pa.scalar(" ", pa.large_string())), None)
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], packed, out.cast(pa.string())], [*names, "ids", "decoded"])

    schema = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names) + "ids binary, decoded string"
    return rows.mapInArrow(run, schema).select(*[F.col(n).alias(c) for n, c in zip(names, rest)], F.col("ids").alias(ids_col), "decoded")


def op11(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    out = decode(encode(docs, vocabulary=vocabulary), vocabulary=vocabulary)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
