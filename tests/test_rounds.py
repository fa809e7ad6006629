"""Round logic: convergence, checkpoint choice, best round, resume, loop restart."""

from pyspark.sql import functions as F

from textprov import tables
from textprov.plans import rounds
from textprov.tables import ROUND_LOG_SCHEMA


def _log(spark, losses):
    rows = [(i + 1, f"m{i+1}", l, 0.9, 0.9, 0.9, 100, 1, 1, 1.0, "p") for i, l in enumerate(losses)]
    return spark.createDataFrame(rows, ROUND_LOG_SCHEMA)


def test_convergence_and_flags(spark):
    log = _log(spark, [0.50, 0.40, 0.3995, 0.45, 0.44])
    conv = {r.round: r.converged for r in rounds.convergence(log).collect()}
    assert conv == {1: False, 2: False, 3: True, 4: False, 5: False}
    f = {r.round: (r.is_new_best, r.better_than_prev) for r in rounds.checkpoint_flags(log).collect()}
    # round 5 is better than round 4 but not the best: the two rules differ
    assert f[5] == (False, True) and f[3] == (True, True) and f[1] == (True, True)
    b = rounds.best_round(log).first()
    assert (b.round, b.val_loss) == (3, 0.3995)


def test_best_round_first_on_ties(spark):
    b = rounds.best_round(_log(spark, [0.3, 0.2, 0.2])).first()
    assert b.round == 2


def test_resume_on_empty_and_filled_log(spark):
    empty = spark.createDataFrame([], ROUND_LOG_SCHEMA)
    r = rounds.resume_round(empty).first()
    assert (r.next_round, r.best_loss, r.rounds_done) == (1, None, 0)
    r = rounds.resume_round(_log(spark, [0.5, 0.4])).first()
    assert (r.next_round, r.best_loss, r.rounds_done) == (3, 0.4, 2)


def _same_texts(spark, first, n_human, n_machine):
    """One text for both labels: a model can only name the more frequent label."""
    text = "the same plain words again and again " * 5
    rows = [(first + i, text, int(i >= n_human), "s", "d", "base", 0, None) for i in range(n_human + n_machine)]
    return spark.createDataFrame(rows, "example_id long, text string, label int, source string, domain string, "
                                       "origin string, round int, parent_id long")


def test_loop_mines_and_survives_a_kill(spark, scratch):
    base = scratch + "/mined"
    pool, val = _same_texts(spark, 0, 12, 36), _same_texts(spark, 1000, 5, 15)

    def loop():
        x = rounds.MiningLoop(spark, base, max_rounds=3, threshold=-1.0, model_kw={"max_iter": 5, "reg": 0.1})
        x.init_pool(pool)
        return x
    # killed between the append and the log: replies and mirrors are there, the log is not
    killed = loop()
    human = pool.filter("label = 0")
    n = killed.mine(1, human)
    sent = killed.table("replies/texts").versions()
    before = sorted(r.example_id for r in killed.pool().filter("round = 1").collect())
    assert n > 0 and len(before) == n and killed.pool(before=1).count() == 48
    log = {r.round: r for r in loop().run(val).collect()}
    assert sorted(log) == [1, 2]                        # every parent is mirrored in round 1
    assert (log[1].n_fp, log[1].n_mirrors, log[1].pool_size) == (12, n, 48)
    assert (log[2].n_fp, log[2].n_mirrors, log[2].pool_size) == (0, 0, 48 + n)
    after = loop().pool()
    assert sorted(r.example_id for r in after.filter("round = 1").collect()) == before
    assert {r.parent_id for r in after.filter("round = 1").collect()} == {r.example_id for r in human.collect()}
    assert loop().table("replies/texts").versions() == sent       # no request was sent twice
    assert loop().table("pool").versions() == [0, 1] and loop().pool(version=0).count() == 48
    assert sorted(r.round for r in loop().run(val).collect()) == [1, 2]         # a finished loop stays finished
    best = min(log.values(), key=lambda r: (r.val_loss, r.round)).round
    assert loop().best_model() == f"{base}/models/round={best}"


def test_converged_round_mines_nothing(spark, scratch):
    loop = rounds.MiningLoop(spark, scratch + "/converged", max_rounds=3, model_kw={"max_iter": 5, "reg": 0.1})
    loop.init_pool(_same_texts(spark, 0, 12, 36))
    r = loop.run_round(1, _same_texts(spark, 1000, 5, 15))
    again = loop.run_round(2, _same_texts(spark, 1000, 5, 15), prev=loop.log().first().val_loss + 1e9)
    assert not r["converged"] and r["n_mirrors"] > 0 and not again["converged"]
    done = loop.run_round(3, _same_texts(spark, 1000, 5, 15), prev=again["val_loss"])
    assert done["converged"] and done["n_mirrors"] == 0


def test_loop_restart_continues(spark, scratch):
    ex = tables.examples(spark, "/root/testdata/sf0.01")
    from textprov.operators.split import stratified_split
    s = stratified_split(ex)
    base = scratch + "/loop"
    loop = rounds.MiningLoop(spark, base, max_rounds=1, model_kw={"max_iter": 5, "reg": 1.0})
    loop.init_pool(rounds.build_pool(s.filter(F.col("split") == "train"), None))
    log1 = loop.run(s.filter(F.col("split") == "val"))
    assert [r.round for r in log1.collect()] == [1]
    # a new driver (after a kill) resumes at round 2 and reuses the stored pool
    loop2 = rounds.MiningLoop(spark, base, max_rounds=2, threshold=-1.0, model_kw={"max_iter": 5, "reg": 1.0})
    loop2.init_pool(rounds.build_pool(s.filter(F.col("split") == "train"), None))
    log2 = loop2.run(s.filter(F.col("split") == "val"))
    got = sorted(r.round for r in log2.collect())
    assert got[0] == 1 and got[-1] <= 2
    pool = loop2.pool()
    assert pool.filter(F.col("round") == 0).count() == s.filter("split = 'train'").filter(F.length("text") > 100).count()
