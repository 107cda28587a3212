import datetime as dt

import pytest

from sparkloom.plans.compiler import compile_question
from sparkloom.plans.grammar import parse

NOW = dt.datetime(2026, 9, 26, 12, tzinfo=dt.timezone.utc)


def test_grammar():
    p = parse('from:@Ann "shard key" -noise after:7d color:red budget', NOW)
    assert p.filters == {"from": ["ann"], "after": ["2026-09-19"]}
    assert (p.phrases, p.exclude, p.terms) == (["shard key"], ["noise"], ["color", "red", "budget"])
    assert not p.natural_language and parse("").is_empty()
    q = parse("what did we decide about the budget", NOW)
    assert q.natural_language and q.retrieval_terms() == ["decide", "budget"]


@pytest.mark.parametrize(
    "question, intent",
    [("how many messages in slack", "aggregate"), ("what is due this week", "deadlines"), ("who is Ann Lee", "person_lookup"), ("anything about sharding", "related"), ("what happened with the launch", "timeline"), ("shard key", "search")],
)
def test_intents(question, intent):
    assert compile_question(question, now=NOW).intent == intent


def test_plan():
    p = compile_question("how many files were shared in slack last week", now=NOW)
    assert p.request.providers == ["slack"] and p.request.after == "2026-09-12" and p.request.kinds == ["file"] and p.execution == "facets"
    assert compile_question("who is Ann Lee", now=NOW).person_hint == "Ann Lee"
    assert compile_question("x after:2026-01-01 tag:y", now=NOW).request.after == "2026-01-01"
    assert compile_question("x tag:y", now=NOW).unsupported == ["filter 'tag'"]
    m = compile_question("x", now=NOW, model=lambda q: {"providers": ["slack"], "kinds": ["nonsense"], "after": "soon"})
    assert m.request.providers == ["slack"] and m.request.kinds == [] and m.request.after == "" and m.compiled_by == "rules+model"
    assert m.plan_id == compile_question("x", now=NOW, model=lambda q: {"providers": ["slack"]}).plan_id
