from tallymill.llm import pii

from . import data

DE, GB, MT = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"


def test_numbers_are_found_whatever_follows(spark):
    plain = DE.replace(" ", "")
    texts = {
        1: (f"IBAN {DE} BIC COBADEFFXXX", [DE]), 2: (f"{plain} EUR", [plain]), 3: (f"{plain} 2024", [plain]), 4: (f"bank {GB} {DE} {MT} AND MORE", [GB, DE, MT]),
        5: (f"ID45 ACCOUNT NUMBER {DE} 5", [DE]), 6: ("DE88 3704 0044 0532 0130 00 BIC COBADEFFXXX", []), 7: (f"😀 {DE}X", []), 8: (f"{MT}.", [MT]), 9: (f"{plain} {plain}", [plain, plain]),
    }
    df = data.frame(spark, [(i, t) for i, (t, _) in texts.items()])
    for r in pii.pii_scan(df).collect():
        text, want = texts[r.doc_id]
        ibans = [s for s in r.found if s.kind == "iban"]
        assert [s.value for s in ibans] == want
        assert [text[s.start : s.end] for s in ibans] == want
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[1] == "IBAN <IBAN> BIC COBADEFFXXX" and out[2] == "<IBAN> EUR"


def test_words_after_a_number_do_not_lengthen_it(spark):
    longer = next(f"{DE} {n}" for n in range(10, 1000) if int("".join(str(int(c, 36)) for c in (f"{DE}{n}".replace(" ", "")[4:] + "DE89"))) % 97 == 1)
    r = pii.pii_scan(data.frame(spark, [(1, f"IBAN {longer}")])).first()
    assert [s.value for s in r.found] == [DE]
