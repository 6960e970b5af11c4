import random
import re

from tintloom.llm import licenses

from .fixtures import documents, no_documents


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    w = words(text)
    hits = [(label, i) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for _, i in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for x, _ in hits}))


def test_base_matches_brute_force(spark):
    rng = random.Random(1)
    bits = [*" ".join(licenses.PHRASES).split(), "MIT", "License", "CC-BY", "x", "ünï", "public\x00license", "by,cc", "mit license mit license"]
    extra = [(5000 + i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    df = documents(spark).unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    want = {r["doc_id"]: brute(r["text"]) for r in df.collect()}
    out = licenses.scan(df).collect()
    assert len(out) == df.count() and sum(v[1] for v in want.values()) > 50
    for r in out:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""}
    assert licenses.scan(no_documents(spark)).count() == 0


def test_templates(spark):
    texts = {
        "Licensed under the Apache License, Version 2.0 (the License)": "apache,apache-2.0",
        "licensed under the apache license version 2.1": "apache",
        "GNU General Public License, version 3 or (at your option) any later version": "gpl,gpl-3.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction": "mit-notice",
        "Permission is hereby granted free of charge to any person obtaining a copy of this one two three four five six seven and associated documentation files to deal in it without restriction": "",
        "This work is CC BY-SA 4.0": "cc-by,cc-by-sa",
        "commit license": "",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(df).collect()}
    assert list(texts.values()) == [got[i] for i in range(len(texts))]


def accepts(template, w):
    """All wordings of a template, spelt out as a pattern over words."""
    out = ""
    for token in re.findall(r"\[\[|\]\]|<\d+>|[^\s\[\]<>]+", template):
        out += "(?:" if token == "[[" else ")?" if token == "]]" else rf"(?: \S+){{0,{token[1:-1]}}}" if token[0] == "<" else "".join(" " + re.escape(x.decode()) for x in licenses.words_of(token))
    return re.match(out + r"(?= |$)", "".join(" " + x for x in w)) is not None


def test_automata_match_patterns():
    rng = random.Random(3)
    for _, template in licenses.TEMPLATES[:8]:
        auto = licenses.Automaton(template)
        vocabulary = [x.decode() for x in licenses.words_of(re.sub(r"[\[\]<>]", " ", template))] + ["other"]
        mandatory = [x.decode() for x in licenses.words_of(re.sub(r"\[\[.*?\]\]|<\d+>", " ", re.sub(r"\[\[[^\[\]]*\[\[.*", " ", template)))]
        for _ in range(200):
            w = list(mandatory)
            for _ in range(rng.randint(0, 4)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(vocabulary))
            if rng.random() < 0.3 and w:
                del w[rng.randrange(len(w))]
            assert (auto.longest([x.encode() for x in w], 0) is not None) == accepts(template, w), (template, w)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED \u201cAS IS\u201d, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""


def wording(template, regions):
    """A template's words, with its optional regions or without; three words stand for a replaceable one."""
    out, opened = [], 0
    for token in re.findall(r"\[\[|\]\]|<\d+>|[^\s\[\]<>]+", template):
        if token in ("[[", "]]"):
            opened += 1 if token == "[[" else -1
        elif regions or not opened:
            out += ["holder"] * min(3, int(token[1:-1])) if token[0] == "<" else [x.decode() for x in licenses.words_of(token)]
    return out


def test_whole_notices_reach_their_last_word(spark):
    cases = []
    for label, template in licenses.WHOLE:
        for regions in (True, False):
            w = wording(template, regions)
            cases.append((label, w, True))
        # without optional regions, all words but the holders' are mandatory
        at = max(i for i in range(1, len(w)) if "holder" not in w[i - 1 : i + 1])
        cases.append((label, [*w[:at], "departs", *w[at:]], False))
    cases += [("mit-text", MIT.split(), True), ("apache-2.0-text", APACHE.split(), True), ("mit-text", MIT.replace("LIABLE", "ANSWERABLE").split(), False)]
    df = spark.createDataFrame([(i, " ".join(["before", *w, "behind"])) for i, (_, w, _) in enumerate(cases)], "doc_id long, text string")
    for r in licenses.scan(df).collect():
        label, w, full = cases[r["doc_id"]]
        assert (label in r["labels"].split(",")) == full, (label, w)
        assert (r["score"] == 1.0) == full
        if full:
            n = len(licenses.words_of(" ".join(w)))
            assert any(x["label"] == label and x["first_word"] == 1 and x["end_word"] >= n - 2 for x in r["notices"]), (label, r["notices"])


def test_the_longest_match_is_noted(spark):
    text = "GNU General Public License, version 3 or (at your option) any later version, and more"
    (r,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(x) for x in r["notices"]] == [("gpl-3.0", 0, 13)]
    assert r["score"] == 0.75
    auto = licenses.Automaton("a [[b [[c]]]]")
    assert [auto.longest(x.encode().split(), 0) for x in ("a", "a b", "a b c", "a c", "b", "")] == [1, 2, 3, 1, None, None]
