from canopy.llm import licenses

PROSE = "the river ran past the old mill and {} then turned to the hills beyond number {}"


def corpus(documents):
    rows = [(i, "\n".join(PROSE.format("ab"[k % 2], i * 7 + k) for k in range(6)), "en", "a") for i in range(60)]
    found = {
        100: ("MIT", "Released under the MIT License."), 101: ("Apache", "Licensed under the Apache License, Version 2.0"),
        102: ("GPL", "This work is licensed under the GNU General Public License, version 3."), 103: ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
        104: ("BSD", "released under the BSD 3-clause license"), 105: ("LGPL", "This library is licensed under the GNU Lesser General Public License"),
    }
    rows += [(i, f"{PROSE.format('x', i)}\n{line}\n{PROSE.format('y', i)}", "en", "a") for i, (_, line) in found.items()]
    rows += [(200, "This thing comes under a proprietary license agreement.", "en", "a")]
    rows += [(300, None, None, None), (301, "", "en", "a"), (None, "Released under the MIT License.", None, None), (302, "word " * 50_000 + "Released under the MIT License.", "en", "a")]
    return documents(rows + rows[:3]), found


def test_scan(spark, documents):
    docs, found = corpus(documents)
    model = licenses.train(docs)
    got = {(r.doc_id, r.paragraph): r for r in licenses.scan(docs, model).collect()}
    for i, (family, _) in found.items():
        assert got[i, 1].family == family and got[i, 1].confirmed and got[i, 1].probability >= licenses.SURE, (i, got[i, 1])
    assert got[200, 0].family == licenses.UNKNOWN and not got[200, 0].confirmed
    assert got[None, 0].family == "MIT" and got[302, 0].family == "MIT"
    assert set(got) == {(i, 1) for i in found} | {(200, 0), (None, 0), (302, 0)}


def test_main_path_is_native(spark, documents):
    docs, _ = corpus(documents)
    plan = licenses.scan(docs, licenses.train(docs))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))


def test_empty_table(spark, documents):
    docs = documents([(1, "x", "en", "a")]).limit(0)
    assert licenses.scan(docs, licenses.train(docs)).count() == 0
