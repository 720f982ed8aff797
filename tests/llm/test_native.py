"""Mixing, URL filters, licence scans and the pipeline."""

import math

import numpy as np
import pytest
import rows
from pyspark.sql import functions as F

from grovelight.llm import licences, mixing, queries, urls


def _targets(sizes, weights=(5, 2, 1), share=1.5, ceiling=2):
    """Water filling by repeated resharing, as the contract tells it."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, capped = share * sum(sizes.values()), set()
    while True:
        left = budget - sum(ceiling * sizes[s] for s in capped)
        total = sum(w[s] for s in names if s not in capped)
        out = {s: ceiling * sizes[s] if s in capped else left * w[s] / total for s in names}
        over = {s for s in names if s not in capped and out[s] > ceiling * sizes[s]}
        if not over:
            return out
        capped |= over


def test_targets_and_taken_words(spark):
    data = [(i, " ".join(["w"] * (1 + i * 7 % 50)), f"s{min(i % 9, 5)}" if i % 11 else None) for i in range(700)]
    data += [(5000, None, "s1"), (5001, "", "only empty"), (5002, "a b c", "s1"), (5002, "a b c", "s1"), (None, "a b", None), (5003, "w " * 20_000, "long")]
    docs = spark.createDataFrame([(*r, 1, "c") for r in data], "doc_id long, text string, source string, rank int, copy string").repartition(4)
    found = mixing.mix(docs).collect()
    assert len(found) == len(data)
    sizes, taken = {}, {}
    for r in found:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    wanted = _targets(sizes)
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(wanted[r["source"]])
    for s in sizes:
        if s != "long":
            assert abs(taken[s] - wanted[s]) <= 3
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    kept = mixing.mixed_documents(docs)
    assert kept.columns == [*docs.columns, "copies"]
    assert kept.agg(F.sum("copies")).first()[0] == sum(r["copies"] for r in found)


def test_unequal_odds_favour_likely_documents(spark):
    data = [(i, "w w w w", "a" if i % 2 else "b", 9.0 if i % 4 < 2 else 1.0) for i in range(2000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, chance double")
    found = mixing.mix(docs, weights=(1, 1), share=0.5, odds="chance").join(docs, ["doc_id", "source"])
    share = {r["chance"]: r["p"] for r in found.groupBy("chance").agg(F.avg("copies").alias("p")).collect()}
    assert share[9.0] == pytest.approx(0.75, abs=0.04) and share[1.0] == pytest.approx(0.25, abs=0.04)  # odds 3 and 1/3 make 0.5 on average


def test_one_source_and_no_source(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, source string")
    assert [(r["target"], r["source_size"]) for r in mixing.mix(docs).collect()] == [(3.0, 2)]
    assert mixing.mix(docs.where("false")).count() == 0
    assert [r["target"] for r in mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).collect()] == [0.0]


def test_rules_and_parts_of_urls(spark):
    cases = {
        "http://A.example.ORG/es/x": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/12?q=/es/": ("example.org", "/en/12", "example.org/en/1", "block"),
        "x://example.org": ("example.org", "", None, "block"),
        "http://b.org/": ("b.org", "/", "org/", "allow"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://a.com/fr/": ("a.com", "/fr/", "com/fr/", "allow"),
        "http://a.com/de/#x": ("a.com", "/de/", "com/de/", "block"),
        "http://h?://z/": ("h", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, None, 1, "h") for i, u in enumerate(cases)], "page_id long, url string, html string, salt int, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, queries.RULES).collect()}
    assert list(cases.values()) == [got[i] for i in range(len(cases))]
    assert urls.judge(pages.where("false"), queries.RULES).count() == 0


def _walks(edges, seeds, damping=0.85, rounds=200):
    hosts = sorted({h for e in edges for h in e} | set(seeds))
    p = np.array([seeds.get(h, 0.0) for h in hosts])
    p = p / p.sum() if p.sum() else p
    m = np.zeros((len(hosts), len(hosts)))
    for a, b in edges:
        m[hosts.index(b), hosts.index(a)] += 1
    m = np.divide(m, m.sum(0), where=m.sum(0) > 0, out=np.zeros_like(m))
    x = p
    for _ in range(rounds):
        y = damping * m @ x
        x = y + p * (p.sum() - y.sum())
    return dict(zip(hosts, x))


def test_trust_and_distrust_follow_links(spark):
    links = [("good.com", "friend.net"), ("friend.net", "far.net"), ("shady.net", "bad.com"), ("darker.net", "shady.net"), ("good.com", "far.net"), ("far.net", "shady.net")]
    pages, n = [], 0
    for host, path in (("good.com", "/fr/"), ("bad.com", "/de/"), ("friend.net", "/"), ("far.net", "/"), ("shady.net", "/"), ("darker.net", "/"), ("alone.net", "/")):
        body = "".join(f'<a href="{q}http{s}://{b.upper() if s else b}/x{q2}>' for (a, b), (q, q2, s) in zip(links, [("", '"', ""), ("", '"', "s")] * 3) if a == host)
        pages.append((n, f"http://{host}{path}", body + '<a href="/local">'))
        n += 1
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["host"]: r for r in urls.judge(frame, queries.RULES, rounds=25).collect()}
    trust, distrust = _walks(links, {"good.com": 1.0}), _walks([(b, a) for a, b in links], {"bad.com": 1.0})
    for host in trust:
        assert got[host]["trust"] == pytest.approx(trust[host], abs=2e-3) and got[host]["distrust"] == pytest.approx(distrust[host], abs=2e-3)
    verdicts = {h: r["verdict"] for h, r in got.items()}
    assert verdicts["shady.net"] == verdicts["darker.net"] == "block" and verdicts["friend.net"] == verdicts["alone.net"] == "allow"


def test_small_scores_still_reach_far_hosts(spark):
    """A chain to one blocked host whose seed weighs 1e-7 of all seeds: every score on it is below 1e-6."""
    chain = ["far.net", "d.net", "c.net", "b.net", "a.net", "bad.com"]
    links = [*zip(chain, chain[1:]), *[(f"f{i}.net", "a.net") for i in range(20)]]
    weights = {"bad.com": 1.0, "huge.com": 1e7}
    edges = spark.createDataFrame([(a, b, 1) for a, b in links], "src string, dst string, n long")
    seeds = spark.createDataFrame([(h, 0, int(w)) for h, w in weights.items()], "host string, trusted long, blocked long")
    got = {r["host"]: r for r in urls.propagate(edges, seeds).collect()}
    distrust = _walks([(b, a) for a, b in links], weights)
    assert 0 < distrust["far.net"] < 1e-8
    for host in distrust:
        assert got[host]["trust"] == 0 and got[host]["distrust"] == pytest.approx(distrust[host], rel=1e-3)


def test_licences(spark):
    texts = dict((t, n) for n, t in licences.SENTENCES)
    by_name = {}
    for t, n in texts.items():
        by_name.setdefault(n, t)
    assert all(any(c in t for c in licences.CUES) for t in texts)
    mit = ". ".join(by_name[i].capitalize() for i in ("mit-grant", "mit-notice", "mit-asis", "mit-liability")) + "."
    cases = {
        1: ("Prose here.\nReleased under the MIT License. More prose!", ["MIT"], [], 3),
        2: ("Intro\n" + mit + "\nAlso: licensed under CC BY-NC 4.0.", ["MIT", "CC-BY-NC-4.0"], [], 7),
        3: (by_name["mit-grant"] + ".", [], ["mit-grant"], 1),
        4: ("THIS WORK is licensed under the GNU General Public License, version 3.0.", ["GPL-3.0-only"], [], 1),
        5: (None, [], [], 0),
        6: ("", [], [], 0),
        7: ("... !!! ...\n\n", [], [], 0),
        8: ("x. " * 30_000 + "Licensed under the Apache License, Version 2.0", ["Apache-2.0"], [], 30_001),
        9: ("Not Released under the MIT License", [], [], 1),
        10: (by_name["gpl-free3"] + ".\n" + by_name["gpl-hope"] + ".", ["GPL-3.0-or-later"], [], 2),
        11: ("." * 50_000, [], [], 0),
    }
    docs = spark.createDataFrame([(i, c[0], "p", 3) for i, c in cases.items()] + [(1, cases[1][0], "p", 3)], "doc_id long, text string, pieces string, rest int")
    got = licences.scan(docs).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        _, names, left, n = cases[r["doc_id"]]
        assert (r["licences"], r["leftover"], r["n_sentences"]) == (names, left, n), r["doc_id"]
    assert licences.scan(docs.where("false")).count() == 0


# The licences' published wording and line breaks.
NOTICES = {
    "GPL-3.0-or-later": """
    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
""",
    "GPL-2.0-or-later": """
    This program is free software; you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation; either version 2 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
""",
    "MPL-2.0": """
This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
    "MIT": """
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
""",
    "BSD-3-Clause": """
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""",
    "ISC": """
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
    "Apache-2.0": """
   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
""",
}


def test_licences_as_published(spark):
    forms = {
        "plain": lambda t: "Copyright (c) 2020 Some One\n" + t,
        "crlf": lambda t: t.replace("\n", "\r\n"),
        "slashes": lambda t: "\n".join("// " + x for x in t.split("\n")) + "\nint x;",
        "stars": lambda t: "/*\n" + "\n".join(" * " + x for x in t.split("\n")) + "\n */",
        "hashes": lambda t: "#!/bin/sh\n" + "\n".join("# " + x for x in t.split("\n")),
        "unwrapped": lambda t: "Intro.\n\n" + "\n\n".join(" ".join(p.split()) for p in t.split("\n\n")),
    }
    cases = [(f"{name} {form}", f(t), name) for name, t in NOTICES.items() for form, f in forms.items()]
    docs = spark.createDataFrame([c[:2] for c in cases], "doc_id string, text string")
    got = {r["doc_id"]: r for r in licences.scan(docs).collect()}
    for i, _, name in cases:
        assert (got[i]["licences"], got[i]["leftover"]) == ([name], []), (i, got[i])


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    """All stages over small tables, held against the brute-force versions of their rules."""
    import brute

    import corpus_pipeline
    from grovelight.llm import language_id

    words = {"en": ["thing", "other", "with", "from", "about", "there"], "fr": ["chose", "autre", "avec", "depuis", "environ", "eux"]}
    import random

    def text(lang, seed, n):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))

    data = [(i, text("fr" if i % 3 == 0 else "en", i, 40 + i % 30), "fr" if i % 3 == 0 else "en", f"s{i % 3}") for i in range(150)]
    shared = text("en", 999, 55)
    data += [(200, data[4][1], "en", "s0"), (201, data[5][1] + " plus", "en", "s1"), (202, None, "en", "s1"), (203, "12 34", "en", "s2")]
    data += [(204, text("en", 300, 60) + " " + shared, "en", "s0"), (205, shared + " " + text("en", 301, 60), "en", "s0")]
    data += [(206, text("en", 400, 30), "en", "s1")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in data], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text("en", 400, 30)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    rejected = {r["doc_id"] for r in language_id.identify_held_out(docs).where("rejected").collect()}
    assert {202, 203} <= rejected and len(rejected) <= 4
    rest = [(d, t) for d, t, *_ in data if d not in rejected]
    rest = [r for r, (_, c) in zip(rest, brute.components(rest)) if c == r[0]]
    assert not {200, 201} & {d for d, _ in rest}
    texts = {d: kept if gone else t for (d, t), (_, gone, kept) in zip(rest, brute.removed(rest))}
    assert len(texts[205].split()) == 60
    del texts[206]  # benchmark
    sizes = {}
    for d, t in texts.items():
        s = next(x[3] for x in data if x[0] == d)
        sizes[s] = sizes.get(s, 0) + len(t.split())
    wanted = _targets(sizes)
    assert set(out) <= set(texts) and all(out[d]["text"] == texts[d] for d in out)
    for s, target in wanted.items():
        assert math.isclose(sum(r["copies"] * len(r["text"].split()) for r in out.values() if r["source"] == s), target, rel_tol=0.05)
