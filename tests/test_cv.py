"""Sections and rules of a curriculum vitae."""

import pytest

from pagewright.config import Config, ConfigError
from pagewright.operators.cv_rules import classify, date_range
from pagewright.plans.detect import cv_issues, detect
from pagewright.sources.corpus import CV_BAD, CV_GOOD

GOOD, BAD = "\n".join(CV_GOOD) + "\n", "\n".join(CV_BAD) + "\n"


@pytest.mark.parametrize(("title", "kind"), [("Positions held", "experience"), (" QUALIFICATIONS: ", "education"), ("Core competencies", "skills"), ("A short profile", "summary"), ("Referees", "references"), ("Selected work", "projects"), ("Weather", None), ("", None)])
def test_kinds(spark, title, kind):
    frame = spark.createDataFrame([(title,)], "t string")
    assert frame.select(classify(frame.t)).first()[0] == kind


@pytest.mark.parametrize(("text", "want"), [("1998 - 2004", (1998, 2004, False)), ("Sept 2017 until now", (2017, None, True)), ("2006 to March 2008, Oslo", (2006, 2008, False)), ("from 2012, ongoing", (2012, 2012, True)), ("in 2001, 1997 and 2010", (1997, 2010, False)), ("presently", (None, None, False)), ("to date", (None, None, True)), ("1850-1860", (None, None, False))])
def test_dates(spark, text, want):
    frame = spark.createDataFrame([(text,)], "t string")
    assert tuple(frame.select(date_range(frame.t)).first()[0]) == want


def test_rules(spark):
    plain = "# Notes\n\n## Skills\n\nSQL\n"
    nested = "# A\n\nwww.a.test\n\n## Education\n\n- one.\n  - two\n"
    long = f"# A\n\nwww.a.test\n\n## Education\n\n- {'x' * 230}\n"
    docs = spark.createDataFrame([("good", GOOD), ("bad", BAD), ("plain", plain), ("nested", nested), ("long", long), ("null", None)], "doc_id string, source string")
    found = {}
    for row in cv_issues(docs).collect():
        found.setdefault(row["doc_id"], {})[row["rule"]] = row["message"]
    assert "good" not in found
    assert set(found["bad"]) == {"cv-missing-contact", "cv-not-reverse-chronological", "cv-bullet-punctuation", "cv-first-person", "cv-weak-opener", "cv-summary-placement"}
    assert found["bad"]["cv-first-person"] == "1 bullet(s) use first-person pronouns (e.g. 'My route was the longest'); a CV conventionally omits them"
    assert set(found["plain"]) == set(found["null"]) == {"cv-missing-section", "cv-missing-contact"}
    assert found["nested"] == {"cv-bullet-punctuation": "1 bullet(s) end with a full stop and 2 do not; pick one and use it throughout"}  # a nested list counts twice
    assert found["long"] == {"cv-bullet-too-long": "1 bullet(s) run past 220 characters (longest is 230); long bullets stop being scannable"}
    assert {r["doc_id"] for r in cv_issues(docs, cv=None).collect()} == {"bad"}


def test_detection_has_the_rules_of_a_cv(spark):
    docs = spark.createDataFrame([("bad", BAD), ("plain", "# Notes\n\nwords\n"), ("good", GOOD)], "doc_id string, source string")
    rules = lambda **more: {(r["doc_id"], r["rule"]) for r in detect(docs, **more).collect()}
    assert {d for d, r in rules() if r.startswith("cv-")} == {"bad"} and not rules(cv=False)
    assert ("plain", "cv-missing-section") in rules(cv=True) and rules(config=Config(cv=False)) == set()
    assert rules(config=Config(cv=True)) == rules(cv=True)
    short = Config(options={"cv-bullet-too-long": {"max_length": 10}})
    assert ("good", "cv-bullet-too-long") in rules(config=short)
    with pytest.raises(ConfigError, match="whole number"):
        rules(config=Config(options={"cv-bullet-too-long": {"max_length": True}}))
    rows = detect(docs, config=Config(rules={"cv-weak-opener": "error", "cv-first-person": False})).filter("doc_id = 'bad'").orderBy("seq").collect()
    assert [r["rule"] for r in rows] == ["cv-bullet-punctuation", "cv-missing-contact", "cv-not-reverse-chronological", "cv-summary-placement", "cv-weak-opener"]
    assert rows[-1]["severity"] == "error"
