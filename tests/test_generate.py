"""Generation: retries, padding, lineage, resume (intent of the reference's mirror tests)."""


from textprov.operators import generate as g


def _no_sleep(s):
    pass


class Seq:
    def __init__(self, outcomes):
        self.outcomes = list(outcomes)

    def __call__(self, payload):
        o = self.outcomes.pop(0)
        if isinstance(o, Exception):
            raise o
        return o


def test_retry_outcomes():
    assert g.call_with_retry(Seq([g.RateLimited(), "ok"]), "p", sleep=_no_sleep) == ("ok", "ok", 2, None)
    assert g.call_with_retry(Seq([g.ServerFailure()] * 3), "p", sleep=_no_sleep) == (None, "failed", 3, "server")
    assert g.call_with_retry(Seq([g.AuthFailure()]), "p", sleep=_no_sleep) == (None, "failed", 1, "auth")
    assert g.call_with_retry(Seq(["", "", ""]), "p", sleep=_no_sleep) == (None, "failed", 3, "empty")
    assert g.call_with_retry(Seq([ValueError(), "x"]), "p", sleep=_no_sleep) == ("x", "ok", 2, None)


def test_backoff():
    assert g.backoff_seconds("rate_limit", 0) == 10 and g.backoff_seconds("rate_limit", 1) == 20
    assert g.backoff_seconds("server", 0) == 6 and g.backoff_seconds("other", 2) == 4


def _texts(spark, n, length=150):
    # word counts vary, so the stub prompt writer answers some items and not others
    return spark.createDataFrame([(i, f"text {i} " + "w " * (length + i)) for i in range(n)],
                                 "example_id long, text string")


def test_empty_input_gives_empty_table(spark):
    members, req = g.prompt_requests(_texts(spark, 0))
    assert req.count() == 0
    rep = g.run_requests(req, g.StubPromptWriter(), sleep=g.no_wait)
    assert rep.count() == 0 and rep.columns == ["request_id", "reply", "status", "attempts", "error"]


def test_one_and_five_prompts(spark):
    for n in (1, 5):
        members, req = g.prompt_requests(_texts(spark, n))
        rep = g.run_requests(req, g.StubPromptWriter(drop_mod=0))
        p = g.padded_prompts(members, req, rep).collect()
        assert len(p) == n and all(len(r.prompt) > 10 and r.from_reply for r in p)


def test_padding_when_reply_is_short(spark):
    members, req = g.prompt_requests(_texts(spark, 3))
    rep = g.run_requests(req, lambda payload: "[1] only one prompt")
    p = sorted(g.padded_prompts(members, req, rep).collect(), key=lambda r: r.ordinal)
    assert p[0].prompt == "only one prompt" and p[0].from_reply
    assert all(r.prompt.startswith("Write a text similar to: ") and not r.from_reply for r in p[1:])


def test_generated_rows_end_to_end_lineage(spark):
    texts = _texts(spark, 23)
    members, req = g.prompt_requests(texts)
    assert sorted(r.n_items for r in req.collect()) == [3, 10, 10]
    rep = g.run_requests(req, g.StubPromptWriter(), sleep=g.no_wait)
    prompts = g.padded_prompts(members, req, rep)
    treq = g.text_requests(prompts)
    rows = g.mirror_rows(treq, g.run_requests(treq, g.StubTextWriter(), sleep=g.no_wait)).collect()
    assert len(rows) == 23
    assert all(r.label == 1 and r.source == "mirror" and len(r.text) > 100 for r in rows)
    assert sorted(r.parent_id for r in rows) == list(range(23))


def test_surplus_parts_have_no_parent(spark):
    members, req = g.prompt_requests(_texts(spark, 2))
    prompts = g.padded_prompts(members, req, g.run_requests(req, g.StubPromptWriter(drop_mod=0)))
    treq = g.text_requests(prompts)
    many = "\n---\n".join(["part " + "x" * 120] * 3)
    rows = g.mirror_rows(treq, g.run_requests(treq, lambda p: many)).collect()
    assert len(rows) == 3 and sum(r.parent_id is None for r in rows) == 1


def test_resume_sends_only_missing(spark):
    members, req = g.prompt_requests(_texts(spark, 40))
    calls = []

    def counting(payload):
        calls.append(payload)
        return "[1] x"
    first = g.run_requests(req.limit(2), counting).cache()
    assert first.count() == 2
    pending = g.pending_requests(req, first)
    assert pending.count() == 2
    g.run_requests(pending, counting).count()


def test_request_ids_are_stable(spark):
    _, r1 = g.prompt_requests(_texts(spark, 25))
    _, r2 = g.prompt_requests(_texts(spark, 25).repartition(7))
    assert sorted(x.request_id for x in r1.collect()) == sorted(x.request_id for x in r2.collect())
