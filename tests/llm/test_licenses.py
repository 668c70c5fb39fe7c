import random

from pyspark.sql import types as T

from tidemark.llm import licenses

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("license", T.StringType())])


def test_notices_and_spans(spark):
    apache = licenses.NOTICES["Apache-2.0 header"]
    rows = [
        (1, "é Übung.\nReleased under the MIT License.\nmore", None),
        (2, f"x y z {apache} tail", "clash"),
        (3, apache.replace("specific language", "wording").replace("writing", "some writing"), None),
        (4, "the license of the work under no version", None),
        (5, "Licensed under CC BY-NC 4.0. words " * 3, None),
        (5, None, None), (6, "", None), (None, "released UNDER\nthe mit license", None),
        (7, "w " * 300_000 + "This work is licensed under the GNU General Public License, version 3.", None),
    ]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    names = sorted((r.doc_id or 0, r.license) for r in got)
    assert names == [(0, "MIT"), (1, "MIT"), (2, "Apache-2.0 header"), (3, "Apache-2.0 header"), (5, "CC-BY-NC-4.0"), (5, "CC-BY-NC-4.0"), (5, "CC-BY-NC-4.0"), (7, "GPL-3.0")]
    first = next(r for r in got if r.doc_id == 1)
    assert rows[0][1][first.start : first.end] == "Released under the MIT License" and first.coverage == 1
    third = next(r for r in got if r.doc_id == 3)
    assert 0.9 < third.coverage < 1 and third.start == 0 and third.end == len(rows[2][1]) - 1
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_planted_notices_are_found():
    """Against a brute-force search of every template at every place."""
    r, index, whole = random.Random(8), licenses.Index(licenses.NOTICES), licenses.Index(licenses.NOTICES, 1.0)
    vocabulary = list(index.words) + [f"w{i}".encode() for i in range(300)]
    for _ in range(200):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 200))]
        name = r.choice(list(index.templates))
        back = {i: w for w, i in index.words.items()}
        notice = [back[i] for i in index.templates[name]]
        at = r.randint(0, len(words))
        text = words[:at] + notice + words[at:]
        found = {(m.first_word, m.license) for m in whole.find(whole.ids(text))}
        want = [(i, n) for n, t in index.templates.items() for i in range(len(text) - len(t) + 1) if index.ids(text[i : i + len(t)]).tolist() == t.tolist()]
        for i, n in want:
            assert (i, n) in found or any(f <= i and i + len(index.templates[n]) <= f + len(index.templates[m]) for f, m in found)
        assert (at, name) in want


def test_edited_short_notices_are_found():
    """Each short notice with words changed down to the coverage demanded, against alignment at every place."""
    r, index = random.Random(5), licenses.Index({**licenses.NOTICES, "one": "Zlib", "two": "Boost Software"})
    back = {i: w for w, i in index.words.items()}
    short = [n for n, t in index.templates.items() if len(t) <= 14]
    assert len(short) >= 9
    held = 0
    for n in range(150):
        name = short[n % len(short)]
        notice = [back[i] for i in index.templates[name]]
        for at in r.sample(range(len(notice)), int(0.2 * len(notice) + 1e-9)):
            notice[at] = b"an"
        ids = index.ids([b"w"] * 20 + notice + [b"w"] * 20)
        band = index.plans[name].band
        every = [index._align(name, index.templates[name], ids, start, band) for start in range(-len(notice), len(ids))]
        want = max((m for m in every if m), key=lambda m: m.matched)
        if want.coverage < 0.8:  # a change beside the end leaves the local alignment shorter
            continue
        held += want.coverage < 1
        assert any(m.first_word <= want.first_word and want.last_word <= m.last_word for m in index.find(ids))
    assert held > 60
    assert [m.license for m in index.find(index.ids(b"released under an mit license".split()))] == ["MIT"]


def test_edited_notices_of_any_length_are_found():
    """Words replaced, left out and put in anywhere, against alignment of every template at every place."""
    r = random.Random(11)
    long = " ".join(f"clause{i % 170} of{i % 13}" for i in range(400))
    index = licenses.Index({**licenses.NOTICES, "long": long})
    back = {i: w for w, i in index.words.items()}
    assert {n for by in index.inverted.values() for posts in by.values() for n, _ in posts} == set(index.templates)
    assert index.plans["long"].window > 1 and index.plans["MIT"].gram == 1
    held = 0
    for n in range(40):
        name = ["long", *licenses.NOTICES][n % (1 + len(licenses.NOTICES))]
        notice = [back[i] for i in index.templates[name]]
        changes = r.randint(0, max(1, int(0.2 * len(notice))))
        for _ in range(changes):
            at = r.randrange(len(notice))
            notice[at : at + r.choice([0, 1, 1])] = r.choice([[], [b"zz"], [b"the"]])
            if not notice:
                break
        ids = index.ids([b"w", b"the"] * 12 + notice + [b"of", b"w"] * 12)
        plan = index.plans[name]
        every = [index._align(name, index.templates[name], ids, start, plan.band) for start in range(-5, len(ids) - len(notice) + 5)]
        want = max((m for m in every if m), key=lambda m: m.matched)
        if want.coverage >= 0.8:
            held += want.coverage < 1
            assert any(m.first_word <= want.first_word and want.last_word <= m.last_word for m in index.find(ids)), (name, want)
    assert held > 15
