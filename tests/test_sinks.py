"""Sinks (K7-K9), the record stream (S6), single and pass-through envelopes."""


from rillet.operators.copy import produce_numbers
from rillet.operators.routing import explode_envelopes, pass_through_envelope, single_envelope
from rillet.streaming.sinks import as_text, ignore, print_each, to_memory


def test_record_stream_to_memory_and_console(spark, new_log, capsys):
    log = new_log()
    produce_numbers(log, 5, "t")
    stream = log.stream_records("t")
    assert stream.isStreaming
    q = to_memory(as_text(stream), "rillet_mem")
    q.awaitTermination()
    assert sorted(r.value for r in spark.table("rillet_mem").collect()) == ["1", "2", "3", "4", "5"]
    print_each(as_text(stream)).awaitTermination()
    ignore(stream).awaitTermination()
    ignore(log.read("t"))


def test_single_and_pass_through_envelopes(spark, new_log):
    log = new_log()
    produce_numbers(log, 3, "t")
    recs = log.read("t")
    single = explode_envelopes(single_envelope(recs, "topicName", keep_key=True)).collect()
    assert {(r.topic, r.key) for r in single} == {("topicName", "key")} and len(single) == 3
    passed = pass_through_envelope(recs)
    assert explode_envelopes(passed).count() == 0
    assert sorted(r.offset for r in passed.select("pass_through.*").collect()) == [0, 1, 2]


def test_print_each_prints_every_element(spark, capsys):
    assert print_each(spark.range(100).selectExpr("id", "'x' AS value")) is None
    assert sorted(capsys.readouterr().out.split()) == sorted([str(i) for i in range(100)] + ["x"] * 100)
