import time

from clauseloom.streaming.ingest import HISTORY_SCHEMA, keep_histories, latest_histories, session_histories, stateful_session


def run(spark, folder, batches, keep):
    """All snapshots of ``batches``, each read by a query of its own, so that state comes back from its store."""
    own = stateful_session(spark)
    source, state, output = (f"{folder}/{name}" for name in ("messages", "state", "out"))
    for batch in batches:
        own.createDataFrame(batch, HISTORY_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = own.readStream.schema(HISTORY_SCHEMA).parquet(source)
        keep_histories(session_histories(stream, keep), output, state).awaitTermination()
    return own.read.parquet(output)


def brute(batches, keep):
    held, cleared = {}, {}
    for batch in batches:
        for session, seq, role, content in batch:
            if role == "clear":
                cleared[session] = max(seq, cleared.get(session, seq))
            elif seq is not None:
                held.setdefault(session, []).append((seq, role, content))
    rows = []
    for session, messages in held.items():
        left = sorted(m for m in messages if session not in cleared or m[0] > cleared[session])
        rows += [(session, *message) for message in left[-keep:]]
    return sorted(rows)


def test_histories_over_batches_with_clears_equal_brute_force(spark, tmp_path):
    said = lambda session, *numbers: [(session, n, "user", f"{session}{n}") for n in numbers]
    batches = [
        said("a", *range(5)) + said("b", 7, 3) + said("c", 1) + [("n", 1, None, None), ("n", None, "user", "lost")],
        said("a", 6, 5) + [("b", 3, "clear", None), ("c", 9, "clear", None)] + said("d", 2),
        said("a", *range(7, 20)) + said("b", 2, 8) + said("c", 4) + [("d", 1, "clear", None)],
        said("c", 10) + said("a", 20),
    ]
    snapshots = run(spark, tmp_path, batches, keep=4).cache()
    found = sorted(tuple(r) for r in latest_histories(snapshots).select("session_id", "seq", "role", "content").collect())
    assert found == brute(batches, 4)
    rounds = {(r.session_id, r.round) for r in snapshots.collect()}
    assert {("a", 4), ("c", 4), ("d", 2)} <= rounds
    # A cleared session is told once, without a message.
    assert [r.seq for r in snapshots.where("session_id = 'c' and round = 2").collect()] == [None]
    assert [r.seq for r in snapshots.where("session_id = 'a' and round = 2").orderBy("seq").collect()] == [3, 4, 5, 6]
    snapshots.unpersist()


def test_messages_expire(spark, tmp_path):
    own = stateful_session(spark)
    source, state, output = (f"{tmp_path}/{name}" for name in ("messages", "state", "out"))
    for seq in (1, 2):
        own.createDataFrame([("a", seq, "user", "x")], HISTORY_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = own.readStream.schema(HISTORY_SCHEMA).parquet(source)
        keep_histories(session_histories(stream, 4, idle_ms=500), output, state).awaitTermination(60)
        time.sleep(1)
    rows = own.read.parquet(output).where("seq is not null").collect()
    assert sorted((r.seq, r.round) for r in rows) == [(1, 1), (2, 1)]
