"""License scan: notices found by the Dice coefficient over word bigrams.

A text's words are its runs of letters a-z and digits, lower-cased; line ends
and wrapping count for nothing. A span of adjacent words is compared, as the
set of its adjacent pairs, with each template's: ``2 * common / (span +
template)``. For a coefficient of ``t`` a span has from ``t / (2 - t)`` to
``(2 - t) / t`` times the template's pairs, and so many of the template's pairs
must be in the text at all: that leaves out nearly every text and template. A
pair that the template has, next to a span, never lowers the coefficient, so
only spans from the start of one run of the template's pairs to the end of
another are compared.

All of it is built-in expressions over one row: no join and no shuffle but for
the few results. Pairs are told by 64-bit hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import table

#: Public notices and full texts by license (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
        " Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        ' "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
        " See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),'
        " to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,"
        " and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by"
        " the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
        " If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "MIT-full": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),'
        " to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,"
        " and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
        " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
        ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,'
        " FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER"
        " LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS"
        " IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above"
        " copyright notice and this permission notice appear in all copies."
        ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF'
        " MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES"
        " WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR"
        " IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
        " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
        " documentation and/or other materials provided with the distribution."
        ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE'
        " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE"
        " LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE"
        " GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT"
        " LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH"
        " DAMAGE."
    ),
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by"
        " the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "LGPL-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by"
        " the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by"
        " the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute"
        " this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising"
        " from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to"
        " alter it and redistribute it freely, subject to the following restrictions:"
    ),
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Apache-2.0-spdx": "SPDX-License-Identifier: Apache-2.0",
    "MIT-spdx": "SPDX-License-Identifier: MIT",
}
#: The least coefficient.
THRESHOLD = 0.8


def normal_words(text: str) -> list[str]:
    low = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower())
    return low.split()


def word_pairs(text: str) -> list[tuple[str, str]]:
    words = normal_words(text)
    return list(zip(words, words[1:], strict=False))


def bounds(n: int, threshold: float) -> tuple[int, int]:
    """Pairs of a span, at least and at most, that can reach the threshold with a template of ``n``."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


def _hash(pair: tuple[str, str]) -> int:
    """The built-in ``xxhash64`` of two strings: the second's, seeded with the first's."""
    import xxhash

    h = xxhash.xxh64_intdigest(pair[1].encode(), xxhash.xxh64_intdigest(pair[0].encode(), 42))
    return h - (h >> 63 << 64)


def _bind(value: Column, f) -> Column:
    """``f`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), f), 0)


def _pairs(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")
    adjacent = lambda w: F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return _bind(words, adjacent)


def _longs(values) -> Column:
    return F.expr("array(" + ", ".join(f"{v}L" if v > -(2**63) else "cast(-9223372036854775808 as bigint)" for v in sorted(values)) + ")")


def scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Notices found: ``doc_id, first_word, last_word, license, common, n_span, dice``.

    Words are numbered from 0. A span begins and ends with a pair of its
    template. Of a text's spans at or above the threshold the one with the most
    common pairs comes first (then the higher coefficient, the earlier start,
    the later end, the license's name), and each following
    one counts if it overlaps none before. A span has, repeats included, no more
    pairs than the size bound. Repeated rows give one result; null and empty
    texts and rows with a null id give none; an empty table gives no rows. Time
    is in proportion to a text's length, but for the spans found: the choice
    among those of one text is quadratic in their number.
    """
    sets = {name: {_hash(p) for p in word_pairs(text)} for name, text in templates.items()}
    if not all(sets.values()) or not 0 < threshold <= 1:
        raise ValueError("each template needs two words, and the threshold is in (0, 1]")
    least = min(bounds(len(s), threshold)[0] for s in sets.values())
    any_pair = _longs(set().union(*sets.values()))
    named = df.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # The filter runs on every text; what follows only on the few that pass.
    some = named.where(F.size(F.array_intersect(_pairs(F.col("text")), any_pair)) >= least).select("doc_id", _pairs(F.col("text")).alias("pairs"))

    span = "struct<minus_common:int,minus_dice:double,first:int,minus_last:int,license:string,u:int>"
    none, pairs = F.expr(f"cast(array() as array<{span}>)"), F.col("pairs")
    rows = [(name, own, *bounds(len(own), threshold)) for name, own in sets.items()]
    templates_ = F.array(
        *[F.struct(F.lit(name).alias("name"), _longs(own).alias("pairs"), F.lit(len(own)).alias("n"), F.lit(low).alias("low"), F.lit(high).alias("high")) for name, own, low, high in rows]
    )

    def spans(t: Column) -> Column:
        """The spans of one template that reach the threshold."""

        def found(hit: Column) -> Column:
            at = F.sequence(F.lit(0), F.size(hit) - 1)
            starts = F.filter(at, lambda i: F.get(hit, i) & ~F.coalesce(F.get(hit, i - 1), F.lit(False)))
            ends = F.filter(at, lambda i: F.get(hit, i) & ~F.coalesce(F.get(hit, i + 1), F.lit(False)))
            return _bind(F.struct(starts.alias("s"), ends.alias("e")), lambda r: F.flatten(F.transform(r.s, lambda s, k: run(r, s, k))))

        def run(r: Column, s: Column, k: Column) -> Column:
            fits = F.filter(F.slice(r.e, k + 1, t.high), lambda e: (e - s + 1 <= t.high) & (e - s + 1 >= t.low))
            return F.filter(F.transform(fits, lambda e: measured(s, e)), lambda x: -x.minus_dice >= threshold)

        def measured(s: Column, e: Column) -> Column:
            sized = lambda x: F.struct(F.size(F.array_distinct(x)).alias("u"), F.size(F.array_intersect(x, t.pairs)).alias("c"))
            return _bind(_bind(F.slice(pairs, s + 1, e - s + 1), sized), lambda m: named(m, s, e))

        def named(m: Column, s: Column, e: Column) -> Column:
            dice = (-2.0 * m.c / (m.u + t.n)).alias("minus_dice")
            return F.struct((-m.c).alias("minus_common"), dice, s.alias("first"), (-e - 1).alias("minus_last"), t["name"].alias("license"), m.u.alias("u"))

        return _bind(F.transform(pairs, lambda x: F.array_contains(t.pairs, x)), found)

    near = F.filter(templates_, lambda t: F.size(F.array_intersect(pairs, t.pairs)) >= t.low)
    every = F.array_sort(F.flatten(F.transform(near, spans)))

    def choose(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda y: (y.first <= -x.minus_last) & (x.first <= -y.minus_last)), kept).otherwise(F.array_append(kept, x))

    first = F.aggregate(every, none, choose)
    return (
        some.select("doc_id", F.explode(first).alias("x"))
        .select(
            "doc_id",
            F.col("x.first").cast("bigint").alias("first_word"),
            (-F.col("x.minus_last")).cast("bigint").alias("last_word"),
            F.col("x.license").alias("license"),
            (-F.col("x.minus_common")).cast("bigint").alias("common"),
            F.col("x.u").cast("bigint").alias("n_span"),
            F.round(-F.col("x.minus_dice"), 6).alias("dice"),
        )
        .distinct()
    )


def query(spark, sf_dir):
    """License notices in every document."""
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in TEMPLATES.items())
    words = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"
    low, high = f"ceil(n * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9)", f"floor(n * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9)"
    return f"""
with recursive tw as (select license, {words} as w from (values {values}) v(license, text)),
tp as (select distinct license, w[i] as a, w[i + 1] as b from (select license, w, unnest(range(1, len(w))) as i from tw)),
tn as (select license, count(*) as n from tp group by license),
d as (select row_number() over () as d, doc_id, {words} as w from (select distinct doc_id, text from documents where doc_id is not null and text is not null)),
p as (select d, i - 1 as i, w[i] as a, w[i + 1] as b from (select d, w, unnest(range(1, len(w))) as i from d)),
h as (select distinct d, i, license from p join tp using (a, b)),
c as (select d, license from (select distinct d, license, a, b from h join p using (d, i)) join tn using (license) group by d, license, n having count(*) >= {low}),
m as (select h.* from h join c using (d, license)),
e as (select *, lag(i) over w is distinct from i - 1 as first, lead(i) over w is distinct from i + 1 as last from m window w as (partition by d, license order by i)),
s as (select x.d, x.license, n, x.i as f, y.i as l from e x join e y on x.d = y.d and x.license = y.license and x.first and y.last and y.i >= x.i
      join tn on tn.license = x.license where y.i - x.i + 1 between {low} and {high}),
u as (select s.d, s.license, n, f, l, count(distinct (p.a, p.b)) as u, count(distinct case when tp.a is not null then (p.a, p.b) end) as k
      from s join p on p.d = s.d and p.i between f and l left join tp on tp.license = s.license and tp.a = p.a and tp.b = p.b group by all),
r as (select *, 2.0::double * k / (u + n) as dice from u),
o as (select *, row_number() over (partition by d order by k desc, dice desc, f, l desc, license) as r from r where dice >= {THRESHOLD}),
g as (
  select d, 0::bigint as r, 0::bigint as f, 0::bigint as l, '' as license, 0::bigint as k, 0::bigint as u, 0::double as dice, false as ok, []::struct(f bigint, l bigint)[] as kept
  from (select distinct d from o)
  union all
  select o.d, o.r, o.f, o.l + 1, o.license, o.k, o.u, o.dice, len(list_filter(kept, lambda y: y.f <= o.l + 1 and o.f <= y.l)) = 0,
    case when len(list_filter(kept, lambda y: y.f <= o.l + 1 and o.f <= y.l)) = 0 then list_append(kept, {{'f': o.f, 'l': o.l + 1}}) else kept end
  from g join o on o.d = g.d and o.r = g.r + 1)
select distinct doc_id, f as first_word, l as last_word, license, k as common, u as n_span, round(dice, 6) as dice from g join d using (d) where ok
"""


SQL = _sql()
