import pytest

from flowframe.plans.builder import Pipeline
from flowframe.plans.parser import PipelineError, parse


def test_parse_words_and_values():
    steps = parse('nullsource count=10 size=1080p name=northsrc ok=true rate=0.5 text="a ! b" ! passthrough ! nullsink')
    assert [s.name for s in steps] == ["nullsource", "passthrough", "nullsink"]
    assert steps[0].properties == {"count": 10, "size": "1080p", "name": "northsrc", "ok": True, "rate": 0.5, "text": "a ! b"}


@pytest.mark.parametrize("bad", ["", "a !", "! a", "a b", "a ! ! b", "x=1 ! a", "a ! ?"])
def test_parse_refuses(bad):
    with pytest.raises(PipelineError):
        parse(bad)


def test_run(spark):
    assert Pipeline.parse("nullsource count=10 ! passthrough ! nullsink").run(spark) is None
    row = Pipeline.parse("testsrc pattern=counter count=7 size=16 ! trim size=4 ! count").run(spark).first()
    assert (row["n_buffers"], row["n_bytes"]) == (7, 28)


def test_graph_rules(spark):
    p = Pipeline().add("nullsource", "s", count=3).add("passthrough", "a").add("passthrough", "b")
    with pytest.raises(PipelineError):
        p.link("b", "a")
    with pytest.raises(PipelineError):
        p.build(spark)
    with pytest.raises(PipelineError):
        p.add("unknown")
    p.add("collect", "rows").add("count", "n", after="a")
    out = p.build(spark)
    assert out["rows"].count() == 3 and out["n"].first()["n_buffers"] == 3
    assert '"s" -> "a"' in p.dot() and "b (transform) <- a" in p.describe() and '"links"' in p.json()
