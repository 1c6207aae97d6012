import textwrap

from driftwood.llm import license_scan


def test_wrapped_and_mid_line_licences(spark):
    other = " ".join(f"word{k}" for k in range(150))
    cases = {}
    for name, t in sorted(license_scan.TEMPLATES.items()):
        cases[len(cases)] = (name, f"{other}\n" + "\n".join("# " + x for x in textwrap.wrap(t, 60)) + f"\n{other}\n{other}", 1.0)
        cases[len(cases)] = (name, f"{other} {t} {other}", 1.0)
    mit = license_scan.TEMPLATES["mit"].split()
    del mit[40:44]
    cases[len(cases)] = ("mit", "\n".join([other, *textwrap.wrap(" ".join(mit), 70), other, other, other, other, other]), None)
    cases[len(cases)] = (None, f"{other} released under the {other} mit license {other}\nsoftware license", None)
    docs = spark.createDataFrame([(k, t) for k, (_, t, _) in cases.items()], "doc_id long, text string")
    for r in license_scan.scan(docs).collect():
        name, text, dice = cases[r.doc_id]
        assert r.license == name and r.n_matches == (name is not None), (name, r, text)
        assert dice is None or r.dice == dice
