"""Files of shuffles that nothing will read again are gone before the next pass over the texts writes its own."""

import time

from proofyard.llm import pst


def test_joins_of_a_level_are_freed_before_the_next(spark, monkeypatch):
    tracker, map_of, left, seen = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker(), pst._map_of, [], []

    def ids():
        return {int(x) for x in tracker.shuffleStatuses().keys().mkString(",").split(",") if x}

    def watching(keys):
        if not seen:
            seen.append(ids())
        elif len(seen) == 2:  # two maps a level: the second level begins
            until = time.time() + 15
            while ids() - seen[0] and time.time() < until:
                time.sleep(0.2)
            left.append(ids() - seen[0])
            seen.append(None)
        else:
            seen.append(None)
        return map_of(keys)

    monkeypatch.setattr(pst, "_map_of", watching)
    pst.grown(spark.createDataFrame([("a b c d e f g " * 5,)] * 40, "text string"), 2)
    assert left == [set()]
