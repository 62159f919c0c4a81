import random
import textwrap

import numpy as np
import pytest

from sediment.llm import license_scan, quality_classifier, toxicity
from tests.llm.conftest import prose


def test_license_blocks_and_winners(spark, empty, clashing):
    rng = random.Random(4)
    body = prose(rng, 100)
    texts = {
        1: f"{body}\nReleased under the MIT License.", 2: f"{body}\nLicensed under CC BY-NC 4.0.\n{body}", 3: body,
        4: f"{body}\nThis work is licensed under the GNU General Public License, version 3.", 5: f"{body}\nThis work is licensed under the GNU General Public License, version 2.",
        6: f"the permission of {body}", 7: license_scan.TEMPLATES["MIT/full"].replace("including but", "including, but"), 8: None, 9: "", 10: f"{body} license {body}",
        11: f"{body}\nLicensed under CC BY 4.0.\n\n\n{prose(rng, 300)}\nLicensed under the Apache License, Version 2.0.", 12: "Licensed under CC BY-SA 4.0.",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = [(r["doc_id"], r["license"]) for r in license_scan.license_scan(df).orderBy("doc_id", "start").collect()]
    assert found == [(1, "MIT"), (2, "CC-BY-NC-4.0"), (4, "GPL-3.0"), (5, "GPL-2.0"), (7, "MIT"), (11, "CC-BY-4.0"), (11, "Apache-2.0"), (12, "CC-BY-SA-4.0")]
    for r in license_scan.license_scan(df).collect():
        assert "icen" in texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] or r["license"] == "MIT"
        assert r["saved_bytes"] == r["plain_bytes"] - r["conditional_bytes"] > 0
    assert license_scan.license_scan(empty).count() == 0 and license_scan.license_scan(clashing).count() == 0


@pytest.mark.parametrize("name", sorted(license_scan.TEMPLATES))
def test_every_template_wins_its_own_wording(name):
    found = license_scan.Scanner().scan(license_scan.TEMPLATES[name])
    assert found[0] == name.partition("/")[0] and found[4] == found[5] == 0


def test_em_recovers_accuracies():
    rng = np.random.RandomState(1)
    accuracy = [0.95, 0.9, 0.8, 0.7, 0.85, 0.6, 0.75, 0.9]
    counts: dict[int, int] = {}
    truth_of: dict[int, list[int]] = {}
    for _ in range(20_000):
        truth = int(rng.rand() < 0.8)
        given = tuple(2 if rng.rand() < 0.2 else truth if rng.rand() < a else 1 - truth for a in accuracy)
        code = quality_classifier.pattern(given)
        counts[code] = counts.get(code, 0) + 1
        truth_of.setdefault(code, []).append(truth)
    shares, prior, post = quality_classifier.expectation_maximisation(counts, [0.49] * 8)
    assert abs(prior - 0.8) < 0.05
    assert np.abs(quality_classifier.accuracies(shares, prior) - accuracy).max() < 0.05
    hits = sum(sum(t == (post[c] >= 0.5) for t in ts) for c, ts in truth_of.items())
    assert hits / 20_000 > 0.93


def test_em_edges():
    assert quality_classifier.expectation_maximisation({})[2] == {}
    assert 0 <= quality_classifier.expectation_maximisation({quality_classifier.pattern((2,) * 8): 5})[2][6560] <= 1


def test_classifier_tells_junk_and_keeps_clean(spark, empty, clashing):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        good = ".\n".join(prose(rng, 20).capitalize() for _ in range(8)) + "."
        junk = [" ".join(w + "$$$" for w in prose(rng, 150).split()), prose(rng, 150).upper().replace(" ", "!! "), " | ".join(prose(rng, 150).split()), "from " * 200][i % 4]
        rows.append((i, junk if i % 5 == 0 else good, "en", "s", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["kept"] for r in quality_classifier.score_documents(df).collect()}
    assert len(got) == 300
    assert all(got[i] for i in range(300) if i % 5) and sum(not got[i] for i in range(0, 300, 5)) >= 55
    assert quality_classifier.score_documents(empty).count() == 0
    assert quality_classifier.score_documents(clashing).count() == clashing.count()


def test_classifier_scores_against_plain_python(spark):
    rng = random.Random(17)
    rows = [(i, ". ".join(prose(rng, 12).capitalize() for _ in range(6)) if i % 3 else "BUY $$$ " * 20) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "word " * 100_000), (73, rows[1][1]), (73, rows[2][1]), (None, rows[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    config = quality_classifier.ScorerConfig()
    weights, bias, post, _ = quality_classifier.fit(df, config)
    counts = {}
    for _, t in rows:
        code = quality_classifier.pattern(quality_classifier.votes(quality_classifier.Measured((t or "").encode())))
        counts[code] = counts.get(code, 0) + 1
    assert post == quality_classifier.expectation_maximisation(counts)[2]
    hashes, light = quality_classifier.FeatureHashes(config.dims), weights.astype(np.float32)

    def plain(text):
        slots, values = quality_classifier.features(quality_classifier.Measured((text or "").encode()), hashes)
        return 1 / (1 + np.exp(-(sum(float(light[s]) * v for s, v in zip(slots, values)) + bias)))

    got = sorted((r["doc_id"] or -1, round(r["score"], 9)) for r in quality_classifier.score_documents(df).collect())
    again = sorted((r["doc_id"] or -1, round(r["score"], 9)) for r in quality_classifier.score_documents(df.repartition(7)).collect())
    assert got == again and len(got) == len(rows)
    assert np.allclose([x for _, x in got], [x for _, x in sorted((i if i is not None and i != 0 else -1, plain(t)) for i, t in rows)], atol=1e-4)


def toxic_rows(n=900):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, 120).split()
        if i % 6 == 0:
            for _ in range(6):
                words[rng.randrange(len(words))] = rng.choice(["grumblefoot", "snotwagon", "dimwitted"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 6 == 0)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score_documents(docs, known).where("held_out").collect()
    toxic = [r for r in got if r["doc_id"] % 6 == 0]
    clean = [r for r in got if r["doc_id"] % 6]
    assert len(got) > 200 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert sum(r["predicted"] for r in toxic) >= 0.9 * len(toxic) and sum(r["predicted"] for r in clean) <= 0.02 * len(clean)


def test_toxicity_never_learns_from_held_out_labels(spark):
    rows, labels = toxic_rows(300)
    import zlib

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert a == b


def test_toxicity_edges(spark, empty, clashing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_documents(clashing, none).collect()} == {0.0}
    rows, labels = toxic_rows(120)
    known = spark.createDataFrame([*labels, (None, 1), (5000, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([*rows, (9001, None), (9002, ""), (9001, "again"), (9003, "x " * 50_000)], "doc_id long, text string")
    assert toxicity.score_documents(docs, known).count() == 124
    assert toxicity.score_documents(empty, known).count() == 0


def test_toxicity_dictionaries_are_whole_windows_of_equal_size(spark):
    rows, labels = toxic_rows(360)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    size = model.config.window
    of = [{w for (_, t), (_, y) in zip(rows, labels) if y == value for w in toxicity.windows(t, size)} for value in (1, 0)]
    assert len(model.pairs) > 1
    for toxic, ordinary in model.pairs:
        assert len(toxic) == len(ordinary)
        for held, allowed in ((toxic, of[0] | of[1]), (ordinary, of[1])):
            parts = [b" " + x + b" " for x in held.strip().split(b"  ")]
            assert sum(p not in allowed for p in parts) <= 2  # cut at the size limit: the first of each part
        assert sum(w in toxic for w in of[0] - of[1]) >= 3 and not any(w in ordinary for w in of[0] - of[1])


def test_toxicity_scores_against_plain_python(spark):
    import math

    import zstandard

    rows, labels = toxic_rows(300)
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known)
    params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTOPT, min_match=4, search_log=4, window_log=17, hash_log=15, chain_log=15, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(data, dictionary):
        held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress(data))

    def plain(text):
        saved = []
        for w in toxicity.windows(text, 6):
            g = [size(w, o) - size(w, t) for t, o in model.pairs]
            low = sorted(g)[: math.ceil(2 * len(g) / 3)]
            saved.append(sum(low) / len(low) if g[0] > 0 and (len(g) < 2 or g[0] + g[1] > 1) else 0)
        top = [max(0, x) for x in sorted(saved, reverse=True)[:3]] + [0, 0]
        c = [sum(x >= k for x in saved) for k in (1, 2, 3, 5)]
        x = [*top[:3], *map(math.log1p, c), 20 * c[1] / max(len(saved), 20), 20 * c[2] / max(len(saved), 20), math.log(len(saved) + 1), 1]
        return 1 / (1 + math.exp(-sum((a - b) / d * e for a, b, d, e in zip(x, model.center, model.scale, model.weights))))

    few = rows[:12]
    assert np.allclose(model.scorer()([t for _, t in few]), [plain(t) for _, t in few])


def test_toxicity_copies_and_repeated_labels(spark):
    rows, labels = toxic_rows(240)
    docs = spark.createDataFrame([*rows, *[(10_000 + i, rows[6][1]) for i in range(500)], (7, "another text of seven")], "doc_id long, text string")
    known = spark.createDataFrame([*labels, *labels, *[(10_000 + i, 1) for i in range(500)], (9, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, known).collect()
    clean = [r for r in got if r["doc_id"] < 240 and r["doc_id"] % 6 and r["held_out"]]
    assert len(got) == 741 and sum(r["predicted"] for r in clean) <= 0.1 * len(clean)


def licences(text: str) -> list[str]:
    return [x[2] for a, b in license_scan.blocks(text) for x in license_scan.Scanner().notices(text[a:b])]


def test_every_notice_of_a_block_is_a_row(spark):
    t = license_scan.TEMPLATES
    text = "\n".join(["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", t["GPL-2.0/notice"], t["GPL-3.0/notice"], t["MIT/full"], "see the license. " * 40, "Released under the MIT License.", t["Apache-2.0/header"]])
    rows = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("start").collect()
    assert [r["license"] for r in rows] == ["Apache-2.0", "MIT", "GPL-2.0", "GPL-3.0", "MIT", "MIT", "Apache-2.0"]
    assert all(r["exact"] for r in rows) and text[rows[1]["start"] :][: rows[1]["length"]] == "Released under the MIT License"
    assert licences("\n".join(t.values())) == [k.partition("/")[0] for k in t]
    assert licences(("Released under the MIT License. " + "words of prose " * 3) * 300) == ["MIT"] * 300


@pytest.mark.parametrize("width", [20, 30, 50])
@pytest.mark.parametrize("sign", ["", "# ", " * ", "// "])
def test_wrapped_notices_are_found(width, sign):
    for name, text in license_scan.TEMPLATES.items():
        wrapped = "\n".join(sign + x for x in textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False))
        assert licences(f"{sign}Some file of ours\n{sign}\n{wrapped}\n\nimport os\n") == [name.partition("/")[0]], name
    assert licences("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.") == ["MPL-2.0"]


def test_spdx_identifiers_and_changed_terms():
    t = license_scan.TEMPLATES
    assert licences("// SPDX-License-Identifier: MIT\n/* SPDX-License-Identifier: GPL-2.0-or-later */\n# SPDX-License-Identifier: Apache-2.0") == ["MIT", "GPL-2.0-or-later", "Apache-2.0"]
    assert licences("SPDX-License-Identifier: Nothing-1.0") == []
    assert licences(t["Apache-2.0/header"].replace("2.0", "1.1")) == []
    for a, b in (("free of charge", "not free of charge"), ("without restriction", "with restriction"), ("is furnished", "is not furnished")):
        assert a in t["MIT/full"] and licences(t["MIT/full"].replace(a, b)) == []
    assert licences(t["MIT/full"].replace("copy, modify, merge", "copy, change, merge")) == ["MIT"]
    assert licences("This work is not licensed under the GNU General Public License, version 3.") == []


def test_notices_against_brute_force():
    """All spans of all short templates by plain longest common subsequences; where they overlap, the most bytes saved."""
    import zstandard

    templates = {k: v for k, v in license_scan.TEMPLATES.items() if len(license_scan._words(v)) <= 14}
    scanner = license_scan.Scanner(templates)
    plain = zstandard.ZstdCompressor(level=19, write_content_size=False)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    def brute(text):
        at = [m.span() for m in license_scan.WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in at]
        found = []
        for name, wording in sorted(templates.items()):
            wanted = [w.lower() for w in license_scan._words(wording)]
            names, loose = license_scan._names(license_scan._words(wording)), license_scan._loose(wanted)
            held = zstandard.ZstdCompressionDict(" ".join(wording.split()).lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            best = {}
            for a in range(len(words)):
                for b in range(a + 1, min(len(words), a + len(wanted) + loose) + 1):
                    span = words[a:b]
                    if span[0] not in wanted or span[-1] not in wanted or not names <= set(span):
                        continue
                    k = common(wanted, span)
                    missing, extra = len(wanted) - k, len(span) - k
                    if missing <= loose and extra <= loose:
                        data = " ".join(text[at[a][0] : at[b - 1][1]].split()).lower().encode()
                        alone, size = len(plain.compress(data)), len(zstandard.ZstdCompressor(level=19, dict_data=held, write_content_size=False).compress(data))
                        if size < alone:
                            best[a, b] = (missing + extra, alone - size)
            for (a, b), (off, saved) in best.items():
                turned = any(words[a:b].count(t) != wanted.count(t) for t in license_scan.TERMS)
                if not turned and not any((x, y) != (a, b) and x < b and a < y and o < off for (x, y), (o, _) in best.items()):
                    found.append((-saved, off, name, a, b))
        taken, out = set(), []
        for _, _, name, a, b in sorted(found):
            if not taken & set(range(a, b)):
                taken |= set(range(a, b))
                out.append((at[a][0], at[b - 1][1], name.partition("/")[0]))
        return sorted(out)

    rng = random.Random(12)
    for _ in range(25):
        parts = []
        for _ in range(4):
            parts.append(prose(rng, rng.randint(0, 6)))
            words = rng.choice(sorted(templates.values())).split()
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = rng.choice(["other", "not", "License", "2.0", "MIT"])
            parts.append(" ".join(words))
        text = "\n".join(parts) + " license"
        got = [(a + x[0], a + x[1], x[2]) for a, b in license_scan.blocks(text) for x in scanner.notices(text[a:b])]
        assert sorted(got) == brute(text), text
