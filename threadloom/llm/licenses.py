"""License scans by diagonal voting.

All rolling word k-grams of every text are joined in Spark to the positions where a template holds the
same k-gram. A match votes for its diagonal (position in the text less position in the
template). Diagonals of one template at most ``GAP`` apart merge, so that a few inserted or missing
words don't split a license. A merged span is verified by the share of the template's words that its
k-grams cover: at least ``COVER``. Of verified spans that begin inside or hold the beginning of one another the one with the greater coverage counts (an
Affero notice isn't a General Public one), of equal ones the longer template, then the first by name.

``TEMPLATES`` holds notices and the telling clauses of the common licenses, not their full texts: one of them is enough to know a license by.

Defined results. Null or empty text, or of fewer than K words: no license. Rows with equal doc_id and
text count once; null doc_ids are left out. Very long texts are scanned whole. A license repeated far apart in a text gives a row each time, one
repeated within GAP words a single row. Templates of fewer than K words are left out. Other columns may have any name. An empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import _text as T
from ._spark import only, small_enough

K, GAP, COVER = 3, 3, 0.65

TEMPLATES: dict[str, str] = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
    "bsd-clauses": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    "apache-2.0-header": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "postgresql": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted",
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc-by-nc-sa-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_words(templates: dict[str, str]) -> dict[str, list[str]]:
    return {name: [w for w in T.normal(pa.array(text.split(), pa.string())).to_pylist() if w] for name, text in templates.items()}


def _rolling(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch["text"].cast(pa.string())
    hashes, offsets = T.words(texts)
    lists = [T.grams(hashes[a:b], K) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    at = np.cumsum([0, *map(len, lists)])
    flat = np.concatenate([*lists, np.zeros(0, T.U64)])
    return pa.record_batch([batch["doc_id"], pa.array(T.signed(T.hash_strings(texts.fill_null("")))), T.ragged(T.signed(flat), at, pa.int64())], ["doc_id", "tie", "grams"])


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, first_word, words (of the span), votes (distinct matches), coverage."""
    spark = docs.sparkSession
    rows = []
    for name, words in template_words(templates).items():
        hashes = T.hash_strings(pa.array(words, pa.string()))
        rows += [(name, len(words), p, int(g)) for p, g in enumerate(T.signed(T.grams(hashes, K)).tolist())]
    places = spark.createDataFrame(rows, "license string, size int, t int, gram long")
    docs = only(docs, doc_id="long", text="string").where("doc_id is not null")
    grams = docs.mapInArrow(T.per_slice(_rolling), "doc_id long, tie long, grams array<long>")
    grams = grams.select("doc_id", "tie", F.posexplode("grams").alias("p", "gram"))
    votes = grams.join(F.broadcast(places) if small_enough(len(rows), 4) else places, "gram").select("doc_id", "tie", "license", "size", "p", "t", (F.col("p") - F.col("t")).alias("diagonal"))
    diagonals = votes.groupBy("doc_id", "tie", "license", "size", "diagonal").agg(F.min("p").alias("p0"), F.max("p").alias("p1"), F.collect_set("t").alias("ts"))
    order = W.partitionBy("doc_id", "tie", "license", "size").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= GAP, 0).otherwise(1)
    spans = diagonals.withColumn("apart", apart).withColumn("span", F.sum("apart").over(order))
    spans = spans.groupBy("doc_id", "tie", "license", "size", "span").agg(F.min("p0").alias("p0"), F.max("p1").alias("p1"), F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + K - 1)))))
    spans = spans.withColumn("coverage", F.round(covered / F.col("size"), 4)).where(F.col("coverage") >= COVER)
    found = F.struct("coverage", "size", "license", F.col("p0"), (F.col("p1") - F.col("p0") + K).alias("words"), F.size("ts").alias("votes"))
    spans = spans.groupBy("doc_id", "tie").agg(F.collect_list(found).alias("xs"))

    def beaten(x, y):
        meet = ((x["p0"] >= y["p0"]) & (x["p0"] < y["p0"] + y["words"])) | ((y["p0"] >= x["p0"]) & (y["p0"] < x["p0"] + x["words"]))
        better = (y["coverage"] > x["coverage"]) | ((y["coverage"] == x["coverage"]) & ((y["size"] > x["size"]) | ((y["size"] == x["size"]) & (y["license"] < x["license"]))))
        return meet & better

    kept = F.filter("xs", lambda x: ~F.exists("xs", lambda y: beaten(x, y)))
    return spans.select("doc_id", F.explode(kept).alias("x")).select("doc_id", "x.license", F.col("x.p0").alias("first_word"), "x.words", "x.votes", "x.coverage")


def oracle(words_sql: str, templates: dict[str, str] = TEMPLATES) -> str:
    values = ", ".join(f"('{name}', {len(ws)}, {t}, '{' '.join(ws[t : t + K])}')" for name, ws in template_words(templates).items() for t in range(len(ws) - K + 1))
    return f"""
WITH tpl(license, size, t, gram) AS (VALUES {values}),
w AS (SELECT row_number() OVER () AS row, doc_id, {words_sql} AS ws FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)),
g AS (SELECT row, doc_id, ws, unnest(range(1, len(ws) - {K - 2})) AS p FROM w WHERE len(ws) >= {K}),
v AS (SELECT row, doc_id, license, size, t, p - 1 AS p, p - 1 - t AS diagonal FROM g JOIN tpl ON {" || ' ' || ".join(f"ws[p + {k}]" for k in range(K))} = gram),
d AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, license ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS apart
      FROM (SELECT row, doc_id, license, size, diagonal, min(p) AS p0, max(p) AS p1, list(DISTINCT t) AS ts FROM v GROUP BY ALL)),
s AS (SELECT *, sum(apart) OVER (PARTITION BY row, license ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM d),
m AS (SELECT row, doc_id, license, size, span, min(p0) AS p0, max(p1) AS p1, list_distinct(flatten(list(ts))) AS ts FROM s GROUP BY ALL),
c AS (SELECT *, round(len(list_distinct(flatten(list_transform(ts, lambda t: range(t, t + {K}))))) / size, 4) AS coverage FROM m),
x AS (SELECT *, p1 + {K} AS p2 FROM c WHERE coverage >= {COVER})
SELECT doc_id, license, p0::INTEGER AS first_word, (p2 - p0)::INTEGER AS words, len(ts)::INTEGER AS votes, coverage FROM x
WHERE NOT EXISTS (SELECT 1 FROM x AS y WHERE y.row = x.row AND y.p0 < x.p2 AND x.p0 < y.p2 AND (y.coverage, y.size) >= (x.coverage, x.size) AND ((y.coverage, y.size) > (x.coverage, x.size) OR y.license < x.license))"""
