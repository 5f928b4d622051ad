import random
import re
import time

import pytest

from labelscope.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i:i + len(p := phrase.split())] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_places_equal_brute_force():
    draw = random.Random(6)
    parts = ["Under", "the", "MIT", "license", "apache", "version", "2", "cc", "by", "nc", "é", "-", "\n", "2.0", "x"]
    texts = [" ".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(500)]
    texts += ["", None, "CC-BY-NC cc by nc", "Apache License, Version 2.0!", "underthe mit license", "under the mit licenses"]
    for text in texts:
        assert licenses.scan((text or "").encode())[:5] == brute_base(text), text


def labels(text):
    return set(licenses.scan(text.encode())[5].split(",")) - {""}


def test_hundreds_of_rules_are_gated_and_ordered():
    every = licenses.rules()
    assert len(every) > 300 and [r.priority for r in every] == sorted(r.priority for r in every)
    assert all(r.keywords for r in every)
    index = licenses.by_keyword()
    assert all(r in index[k] for r in every for k in r.keywords)


def test_priority_and_containment():
    assert labels("GNU General Public License version 2 or any later version") == {"gpl-2-or-later"}
    assert labels("released under the GNU Lesser General Public License, v2.1") == {"lgpl-2.1"}
    assert labels("CC BY-NC-SA 4.0") == {"cc-by-nc-sa-4", "cc-by-nc"}  # the base phrase stays
    assert labels("the Apache License") == {"apache"}
    assert labels("under the MIT license or version 3 of the gpl") == {"mit", "gpl-3"}
    assert labels("er ging mit der license nach Hause") == set()


def test_suppression_is_by_interval():
    inside = licenses.scan(b"gnu gpl version 3")[7]
    assert [(d["label"], d["first"], d["last"]) for d in inside] == [("gpl-3", 0, 3)]
    twice = licenses.scan(b"gpl v3 and then gpl v2")[7]
    assert [d["label"] for d in twice] == ["gpl-3", "gpl-2"]


def test_odd_rows(spark, odd, none):
    out = licenses.scan_licenses(odd)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == odd.count() and licenses.scan_licenses(none).count() == 0
    assert (got[3].n_words, got[3].n_base, got[3].first_word, got[3].base_labels, got[3].labels, got[3].score) == (0, 0, None, "", "", 0.0)
    assert got[8].n_words == 2 and got[6].n_words > 9000


def by_definition(text):
    """Every rule on the whole text without a gate, in order; a match inside an earlier one is dropped."""
    joined = b" " + b" ".join(licenses.split_words(text)) + b" "
    kept = []
    for rule in licenses.rules():
        for m in rule.pattern.finditer(joined):
            first = joined[:m.start()].count(b" ") - 1
            last = first + m.group().count(b" ")
            if not any(a <= first and last <= b for a, b, *_ in kept):
                kept.append((first, last, rule.priority, rule.label, rule.confidence))
    return sorted(kept)


def test_gate_and_suppression_equal_the_definition():
    draw = random.Random(8)
    words = ("gnu general public license version v 2 3 1 0 or later any gpl lgplv2 gplv3 agplv3 gpl3 apache mit under the terms of cc by nc sa 4 creative commons "
             "attribution noncommercial bsd clause licence mozilla mpl x licensed").split()
    for _ in range(400):
        text = " ".join(draw.choice(words) for _ in range(draw.randint(0, 60))).encode()
        joined = b" " + b" ".join(licenses.split_words(text)) + b" "
        assert licenses.detect(joined, licenses._gate().intersection(licenses.split_words(text))) == by_definition(text), text


@pytest.mark.parametrize(("text", "label"), [
    ("GPLv3", "gpl-3"), ("released under GPLv2 or later", "gpl-2-or-later"), ("LGPLv2.1", "lgpl-2.1"), ("AGPLv3", "agpl-3"), ("GPL3", "gpl-3"), ("MPLv2.0", "mpl-2")])
def test_names_joined_with_versions(text, label):
    assert licenses.scan(text.encode())[5].split(",") == [label]


def test_many_licence_names_take_linear_time():
    text = b"GPL version 2 Apache License 2.0 MIT license BSD 3 clause LGPLv2.1 under the MIT license CC BY NC 4.0 MPL 2 "
    def seconds(copies):
        start = time.perf_counter()
        licenses.scan(text * copies)
        return time.perf_counter() - start
    seconds(10)
    few, many = seconds(500), seconds(4000)  # some 10,000 and 80,000 words
    assert many < 24 * few  # a quadratic scan takes 64 times as long
