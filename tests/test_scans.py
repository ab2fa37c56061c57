"""What reaches the readers of audio, and engines of one's own."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_transcripts import wav

from auricle import schemas
from auricle.operators import engines
from auricle.sources import scans


def test_audio_scan_prunes_and_pushes(spark, tmp_path):
    """The filter on length reaches the source, which leaves large files unread; content is not read unless selected."""
    for i in range(5):
        (tmp_path / f"{i}.wav").write_bytes(wav(range(i * 100)))
    rows = scans.scan_audio_corpus(spark, str(tmp_path))
    small = rows.where("length < 400").select("path", "length")
    plan = small._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan binaryFile" in line)
    assert "LessThan(length,400)" in scan.split("PushedFilters")[1] and "content" not in scan.split("ReadSchema")[1]
    assert small.count() == 2
    with_content = rows.where("length < 400").select(F.sha2("content", 256))
    assert "content" in with_content._jdf.queryExecution().executedPlan().toString() and with_content.count() == 2


def test_registered_engine_and_no_speech(spark):
    """An engine of one's own by name; no speech is an empty text and no tokens, not an error."""

    def make(threshold):
        class Loudness:
            def transcribe(self, samples, sample_rate):
                loud = float(np.abs(samples).max()) >= threshold
                return {"text": "noise", "language": "en", "tokens": ["noise"], "timestamps": [0.0]} if loud else {}

            def model_type(self):
                return "loudness"

            def close(self):
                pass

        return Loudness

    name = "loudness-of-this-test"
    if name not in engines.REGISTRY:
        engines.register(name, make)
    df = spark.createDataFrame([(1, 16_000, [0.1] * 2000), (2, 16_000, [0.9] * 2000), (3, 16_000, [])], schemas.SAMPLES)
    got = {r.clip_id: r for r in engines.transcribe(df, engines.engine(name, threshold=0.5)).collect()}
    assert (got[1].text, got[1].tokens, got[1].error, got[1].language) == ("", [], None, "") and (got[2].text, got[2].tokens) == ("noise", ["noise"]) and got[3].text == ""
    with pytest.raises(ValueError, match="there already"):
        engines.register(name, make)
    with pytest.raises(ValueError, match="unknown engine"):
        engines.engine("none")
