import numpy as np

from echoframe.operators.embed import precomputed, run_model


class Session:
    """Stands in for a model: the mean of the tokens that the mask shows."""

    def run(self, names, feeds):
        assert names == ["pooler_output"]
        ids, mask = feeds["input_ids"], feeds["attention_mask"]
        return [((ids * mask).sum(1, keepdims=True) / mask.sum(1, keepdims=True)).astype(np.float32)]


def test_a_batch_is_padded_and_masked():
    assert run_model(Session(), [[2, 4], [3, 3, 9]]).tolist() == [[3.0], [5.0]]


def test_precomputed(spark):
    df = spark.createDataFrame([(7, [1.0, 2.0])], "id int, v array<double>")
    assert precomputed(df, "id", "v").first().asDict() == {"idx": 7, "vector": [1.0, 2.0]}
