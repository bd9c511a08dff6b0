from __future__ import annotations

from pyspark.sql import functions as F

from listweave.functions import money, text

A, B, C = F.col("a"), F.col("b"), F.col("c")


def test_experience_level_first_match_decides(value_of):
    raw = ["", None, "EXPERT mid", "mid entry", "IntermediateLevel", "Basic", "Entry Level", "Guru"]
    assert value_of(text.experience_level(A), *raw) == [
        "N/A", "N/A", "Expert", "Intermediate", "Intermediate", "Entry", "Entry", "Guru",
    ]


def test_spend_band_boundaries(value_of):
    amounts = {
        None: "", "": "", "0": "", "0.0": "", "0.5": "$0", "1.5": "$2", "2.5": "$2", "999": "$999",
        "999.5": "$1000", "1000": "$1K+", "1500": "$2K+", "2500": "$2K+", "5000.0": "$5K+",
        "999999": "$1000K+", "1000000": "$1.0M+", "1150000": "$1.2M+", "1250000": "$1.2M+",
        "1.0E7": "$10.0M+", "not a number": "",
    }
    assert value_of(money.spend_band(A), *amounts) == list(amounts.values())


def test_job_type(value_of):
    assert value_of(text.job_type(A), "1", "2", "3", "x", None, "1.0") == [
        "HOURLY", "FIXED", "N/A", "N/A", "N/A", "HOURLY",
    ]


def test_state_budget(value_of):
    hourly = money.state_budget(F.lit("HOURLY"), A, B, C)
    rows = [("25.0", "50", None), ("0", "50", None), ("0.0", "", None), (None, None, "7"), ("25", None, None)]
    assert value_of(hourly, *rows) == ["$25.0-$50/hr", "$0-$50/hr", "N/A", "N/A", "$25-$0/hr"]
    fixed = money.state_budget(F.lit("FIXED"), A, B, C)
    rows = [(None, None, "300.0"), ("1", "2", "0"), ("1", "2", None), (None, None, "1.25E7")]
    assert value_of(fixed, *rows) == ["$300.0", "N/A", "N/A", "$12500000.0"]


def test_api_budget(value_of):
    hourly = money.api_budget(F.lit("HOURLY"), A, B, C)
    assert value_of(hourly, ("25.0", "50.0", None), (None, "0", None)) == ["$25.0-$50.0/hr", "$?-$0/hr"]
    fixed = money.api_budget(F.lit("FIXED"), A, B, C)
    assert value_of(fixed, (None, None, "0"), ("1", "1", None)) == ["$0", "N/A"]


def test_api_budget_exact_tells_null_from_absent(value_of):
    fields = F.from_json(A, "map<string, string>")
    exact = money.api_budget_exact(F.lit("HOURLY"), fields)
    assert value_of(exact, '{"hourlyBudgetMin": null}', '{"hourlyBudgetMin": 3, "hourlyBudgetMax": 4.5}') == [
        "$None-$?/hr", "$3-$4.5/hr",
    ]
    fixed = money.api_budget_exact(F.lit("FIXED"), fields)
    assert value_of(fixed, '{"fixedPriceAmount": {"amount": 9}}', '{"fixedPriceAmount": null}') == ["$9", "N/A"]


def test_excerpt_strips_all_white_space_then_cuts(value_of):
    long = " \t\n  " + "é" * 600 + "\r\n"
    inner = "a \n b"
    assert value_of(text.excerpt(A), long, f"\x1c{inner}\x1f", None, "   ") == ["é" * 500, inner, "", ""]


def test_skills_cut_before_blanks_go(value_of):
    assert value_of(text.top_skills(F.split(A, ",")), "a,,b,c,d,e,f", "", "x") == ["a, b, c, d", "", "x"]
    assert value_of(text.top_skills(F.lit(None).cast("array<string>")), "a") == [""]


def test_yes_no(value_of):
    assert value_of(text.yes_no(A.cast("boolean")), "true", "false", None) == ["Yes", "No", ""]


def test_two_decimals_and_whole_number(value_of):
    number = money.two_decimals(A.try_cast("double"))
    assert value_of(number, "4.9", "5", "4.125", "4.135", "-0.5", None, "x") == [
        "4.90", "5.00", "4.12", "4.14", "-0.50", "", "",
    ]
    assert value_of(money.whole_number(A.cast("bigint")), "12", None) == ["12", ""]


def test_links_and_urns(value_of):
    assert value_of(text.job_url(A), "~02ab", "", None) == ["https://www.upwork.com/jobs/~02ab", "N/A", "N/A"]
    assert value_of(text.without_query(A), "http://x/y?a=1?b#c", "http://x/y#c", "?a") == [
        "http://x/y", "http://x/y#c", "",
    ]
    assert value_of(text.urn_tail(A), "urn:li:jobPosting:12", "12", "a:", "") == ["12", "12", "", ""]


def test_cipher_strip(value_of):
    ciphers = ["~02abc", "~~00x0~", "abc", "~0", ""]
    assert value_of(text.stripped_cipher(A), *ciphers) == ["2abc", "x0~", "abc", "", ""]
    assert value_of(text.stripped_cipher(A, strip_version=True), "~02abc", "~0abc") == ["abc", "~0abc"]


def test_fallbacks(value_of):
    chain = text.first_filled(A, B, default="N/A")
    assert value_of(chain, ("x", "y"), ("", "y"), (None, ""), (None, None)) == ["x", "y", "N/A", "N/A"]


def test_lists(value_of):
    assert value_of(text.split_list(A), " 2, 4 ,,\t5", "", None) == [["2", "4", "5"], [], None]
    assert value_of(text.joined(F.split(A, " ")), "a b") == ["a,b"]


def test_all_terms(value_of):
    found = text.all_terms(A, B, C)
    rows = [("Rust dev", "RUST", "web DEVeloper"), ("rust dev", "rust", None), ("  ", "x", "y")]
    assert value_of(found, *rows) == [True, False, True]


def test_budget_bounds(value_of):
    low, high = money.budget_bounds(A)
    texts = ["$25.0-$50/hr", "$300", "N/A", "$?-$7.5/hr", ""]
    assert [str(v) for v in value_of(low, *texts)] == ["25.00", "300.00", "None", "7.50", "None"]
    assert [str(v) for v in value_of(high, *texts)] == ["50.00", "300.00", "None", "7.50", "None"]
