"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates.

Templates are notices and whole license texts. A block is a line, or a stretch of the text's words regardless of line
ends. Templates of like length share a width, the least power of two that is twice their longest or more, and have
stretches of that many words, each half overlapping the next: every run of words as long as a template lies in one,
however it is wrapped, and short templates aren't looked for in long stretches. A block matches a template if it holds at
least the threshold's share of the template's distinct words. Words of the templates are ordered by how many blocks of
the corpus hold them, rarest first. With o words needed of n, a match must share one of the template's first n - o + 1
words (prefix filter), must have o words itself (length filter), and from the first shared word on both must have enough
words left (positional filter). Pairs that pass are verified by full intersection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Notices and license texts as published, by label.
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("apache-2", "licensed under the Apache License Version 2.0"),
    ("gpl-3", "this work is licensed under the GNU General Public License version 3"),
    ("cc-by-nc", "licensed under CC BY NC 4.0"),
    ("cc-by-nc", "this work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("all-rights-reserved", "all rights reserved"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE
        USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
        License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
        on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License."""),
    ("gpl", "you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
        received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of
        source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS
        PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
        THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
        and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
        USE OR PERFORMANCE OF THIS SOFTWARE."""),
]
THRESHOLD, LEAST = 0.8, 32

_WORD = set(b"abcdefghijklmnopqrstuvwxyz0123456789") | set(range(0x80, 0x100))
_TO_SPACE = bytes(c if c in _WORD else 0x20 for c in bytes(range(256)).lower())
_KEEP_LINES = bytes(0x0A if c == 0x0A else x for c, x in enumerate(_TO_SPACE))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of letters, digits and all characters beyond ASCII."""
    return (text or "").encode().translate(_TO_SPACE).split()


def _places(words: list[bytes], phrases: list[tuple[bytes, str]]) -> list[tuple[int, str]]:
    joined, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases:
        at, last, n = joined.find(phrase), 0, 0
        while at >= 0:
            n += joined.count(b" ", last, at)
            last = at
            found.append((n, label))
            at = joined.find(phrase, at + 1)
    return found


def widths(templates: list[tuple[str, str]], least: int = LEAST) -> list[int]:
    """Of each template the width of the stretches that it is looked for in."""
    return [max(least, 1 << (2 * len(words_of(t)) - 1).bit_length()) for _, t in templates]


def _stretches(codes: np.ndarray, width: int) -> list[np.ndarray]:
    """Distinct codes (0 or more; others count for nothing) of the stretches of a text, which start at each half width."""
    half = width // 2
    at = np.flatnonzero(codes >= 0)
    last = max(0, -(-len(codes) // half) - 2)  # the last stretch reaches the text's end
    stretch = np.concatenate([np.minimum(at // half, last), np.maximum(at // half - 1, 0)])
    pairs = np.unique(stretch << 32 | np.concatenate([codes[at], codes[at]]))
    return np.split(pairs & 0xFFFFFFFF, np.flatnonzero(np.diff(pairs >> 32)) + 1) if len(pairs) else []


def scan(
    docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
    least: int = LEAST, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row a document: id, n_words, n_base (places of phrases), first_word, last_word (smallest and largest start of
    a place in words from 0, else null), base_labels and labels (arrays, sorted, distinct; labels has the templates'
    too), score (largest share of a template's words in one block, 0 if none reaches the threshold; a place counts 1).

    Lines of at most the least width are blocks for its templates, stretches for all of theirs. Null texts count as empty; texts
    of any length are read whole. Null ids and repeated rows are kept as they are. An empty table gives an empty result.
    Other columns are not read, whatever their names.
    """
    wanted = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases]
    sets = [(label, sorted(set(words_of(t)))) for label, t in templates]
    number = {w: i for i, w in enumerate(sorted({w for _, s in sets for w in s}))}
    need = [math.ceil(threshold * len(s) - 1e-9) for _, s in sets]
    width = widths(templates, least)
    # Of each width: its templates' words, and the fewest words that any of them needs.
    kinds = {w: (np.isin(np.arange(len(number)), [number[x] for (_, s), v in zip(sets, width, strict=True) if v == w for x in s]), min(n for n, v in zip(need, width, strict=True) if v == w)) for w in sorted(set(width))}
    
    def blocks(plain: bytes, words: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        codes = np.fromiter((number.get(w, -1) for w in words), np.int64, len(words))
        for w, (own, few) in kinds.items():
            mine = np.where((codes >= 0) & own[codes], codes, -1) if len(own) else codes
            if np.count_nonzero(mine >= 0) < few:
                continue
            for found in _stretches(mine, w):
                if len(found) >= few:
                    yield w, found
            if w == least and b"\n" in plain:
                sizes = [len(line.split()) for line in plain.split(b"\n")]
                for line in np.split(mine, np.cumsum(sizes)[:-1]):
                    if few <= len(line) <= w and len(found := np.unique(line[line >= 0])) >= few:
                        yield w, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40  # a key for each row
        for b in batches:
            rows = []
            for text in b["text"].to_pylist():
                plain = (text or "").encode().translate(_KEEP_LINES)
                words = plain.split()
                found = _places(words, wanted)
                at = [p for p, _ in found]
                rows.append({"key": key, "n_words": len(words), "n_base": len(at), "first_word": min(at, default=None), "last_word": max(at, default=None), "base_labels": sorted({x for _, x in found}), "blocks": [{"width": w, "tokens": t} for w, t in blocks(plain, words)]})
                key += 1
            schema = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("blocks", pa.list_(pa.struct([("width", pa.int32()), ("tokens", pa.list_(pa.int32()))])))])
            out = pa.RecordBatch.from_pylist(rows, schema)
            yield pa.RecordBatch.from_arrays([b["id"], *out.columns], ["id", *schema.names])

    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    base = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, key long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, blocks array<struct<width: int, tokens: array<int>>>"), "licenses")
    blocks_of = base.select("key", F.posexplode("blocks").alias("no", "b")).select("key", "no", "b.*")
    counted = {r[0]: r[1] for r in blocks_of.select(F.explode("tokens").alias("t")).groupBy("t").count().collect()}  # at most one row a word of the templates
    order = {t: i for i, t in enumerate(sorted(number.values(), key=lambda t: (counted.get(t, 0), t)))}
    ordered = [(label, sorted(order[number[w]] for w in s)) for label, s in sets]
    prefixes = spark.createDataFrame(
        [(t, width[k], k, label, at, len(s), need[k], s) for k, (label, s) in enumerate(ordered) for at, t in enumerate(s[: len(s) - need[k] + 1])],
        "token int, width int, template int, label string, at int, n int, need int, all array<int>",
    )
    by_rank = F.array(*[F.lit(order[t]) for t in range(len(number))]) if number else F.array().cast("array<int>")
    ranked = blocks_of.withColumn("tokens", F.sort_array(F.transform("tokens", lambda t: F.get(by_rank, t))))
    probes = ranked.select("key", "width", "tokens", F.posexplode("tokens").alias("pos", "token"))
    pairs = probes.join(F.broadcast(prefixes), ["token", "width"]).where("size(tokens) >= need and least(n - at, size(tokens) - pos) >= need")  # templates are a fixed list
    overlap = F.size(F.array_intersect("tokens", "all"))
    hits = pairs.withColumn("share", overlap / F.col("n")).where(overlap >= F.col("need")).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))  # a label each at most
    none = F.array().cast("array<string>")
    return base.drop("blocks").join(hits, "key", "left").select(
        "id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.sort_array(F.array_union("base_labels", F.coalesce("more", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
