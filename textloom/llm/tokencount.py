"""Token counts under a unigram model, computed on tries of pre-tokens.

Pre-tokens are the words `[^\\x20\\x09-\\x0D]+`, each with the word mark in front. The pieces are those of
a public vocabulary file; a piece's probability follows its place in that file by Zipf's law, since
tokenizers are not trained here. A word's count is the length of its most probable segmentation;
ties go to fewer pieces. Characters outside the vocabulary cost one piece a UTF-8 byte.

Each task inserts the distinct words of a batch that it has not met before in a trie, level by
level. The forward score of a node depends on its prefix alone, so it is computed once for all words
that share the prefix, for a whole level at a time; the counts at word ends are kept for later
batches. Nothing is shuffled, and a task keeps at most CACHED words.

Nulls: a null text has no words; a null id is passed on. Repeated rows are counted one by one. An
empty table gives no rows; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm import common as C

MARK = "▁"
CACHED = 2_000_000
LONG = 256
BYTE_COST = 40.0


def vocabulary(file=None):
    """Piece to score, from a SentencePiece vocabulary file."""
    import sentencepiece

    if file is None:
        import public_tokenizers as P

        file = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=file)
    return {model.id_to_piece(i): -float(np.log(i + 1.0)) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}


class Model:
    """Pieces as a trie of their reversed characters, in sorted arrays."""

    def __init__(self, pieces):
        self.pieces, self.longest = pieces, max(map(len, pieces))
        edges, states, scores = {}, 1, {}
        for piece, score in pieces.items():
            at = 0
            for c in map(ord, reversed(piece)):
                nxt = edges.get((at, c))
                if nxt is None:
                    edges[at, c] = nxt = states
                    states += 1
                at = nxt
            scores[at] = score
        keys = np.array([(s << 21) | c for s, c in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], np.array(list(edges.values()), np.int64)[order]
        self.scores = np.full(states, -np.inf)
        self.scores[list(scores)] = list(scores.values())

    def step(self, state, char):
        key = (state << 21) | char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], -1)

    def counts(self, words):
        """Pieces of each distinct word, by one pass over the levels of their trie."""
        out = np.zeros(len(words), np.int64)
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.count(w)
        if short:
            out[short] = self.trie_counts([words[i] for i in short])
        return out

    def trie_counts(self, words):
        marked = [MARK + w for w in words]
        sizes = np.array([len(w) for w in marked])
        chars = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        parent, char = [np.array([-1])], [np.array([0])]
        best, count = np.zeros(1), np.zeros(1, np.int64)
        node, alive, out = np.zeros(len(words), np.int64), np.arange(len(words)), None
        out = np.zeros(len(words), np.int64)
        parents, letters, first = parent[0], char[0], 1
        for level in range(int(sizes.max())):
            alive = alive[sizes[alive] > level]
            key = (node[alive] << 21) | chars[starts[alive] + level]
            fresh, of = np.unique(key, return_inverse=True)
            parents = np.concatenate((parents, fresh >> 21))
            letters = np.concatenate((letters, fresh & ((1 << 21) - 1)))
            best = np.concatenate((best, np.empty(len(fresh))))
            count = np.concatenate((count, np.empty(len(fresh), np.int64)))
            self.forward(np.arange(first, first + len(fresh)), parents, letters, best, count)
            node[alive] = first + of
            first += len(fresh)
            ended = alive[sizes[alive] == level + 1]
            out[ended] = count[node[ended]]
        return out

    def forward(self, nodes, parents, letters, best, count):
        """Best score and its count for nodes whose ancestors are known."""
        before = parents[nodes]
        size = utf8_size(letters[nodes])
        top, fewest = best[before] - BYTE_COST * size, count[before] + size
        at, state, left = nodes, np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        while len(left):
            state = self.step(state, letters[at])
            going = state >= 0
            left, at, state = left[going], parents[at[going]], state[going]
            score, pieces = best[at] + self.scores[state], count[at] + 1
            better = (score > top[left]) | ((score == top[left]) & (pieces < fewest[left]))
            top[left[better]], fewest[left[better]] = score[better], pieces[better]
            inner = at > 0
            left, at, state = left[inner], at[inner], state[inner]
        best[nodes], count[nodes] = top, fewest

    def count(self, word):
        """The same for one word alone, for words too long to share a trie."""
        text = MARK + word
        best, count = [0.0], [0]
        for i in range(1, len(text) + 1):
            size = len(text[i - 1].encode())
            top, fewest = best[i - 1] - BYTE_COST * size, count[i - 1] + size
            for k in range(1, min(i, self.longest) + 1):
                score = self.pieces.get(text[i - k:i])
                if score is not None:
                    s, n = best[i - k] + score, count[i - k] + 1
                    if s > top or (s == top and n < fewest):
                        top, fewest = s, n
            best.append(top)
            count.append(fewest)
        return count[-1]


def utf8_size(c):
    return 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)


MODEL = None


def count_batches(batches):
    global MODEL
    if MODEL is None:
        MODEL = Model(vocabulary())
    known = {}
    for b in batches:
        split = [t.split() for t in b["text"].to_pylist()]
        new = list({w for ws in split for w in ws if w not in known})
        if len(known) + len(new) > CACHED:
            known = {}
            new = list({w for ws in split for w in ws})
        if new:
            known.update(zip(new, MODEL.counts([w.decode() for w in new]).tolist()))
        totals = [sum(map(known.__getitem__, ws)) for ws in split]
        yield pa.RecordBatch.from_arrays(
            [b["doc_id"].cast(pa.int64()), pa.array([len(ws) for ws in split], pa.int64()),
             pa.array(totals, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_pretokens and n_tokens of every row."""
    return docs.select("doc_id", C.text_bytes().alias("text")).mapInArrow(
        count_batches, "doc_id long, n_pretokens long, n_tokens long")
