import numpy as np
import pytest

from factgraph.sources import npz_embeddings


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_blocks_of_an_archive(spark, tmp_path, save):
    names = np.array([f"né{i % 90}" for i in range(200)])
    vectors = np.random.default_rng(1).normal(size=(200, 3)).astype(np.float32)
    save(tmp_path / "e.npz", names=names, embeddings=vectors)
    got = {r.name: r.embedding for r in npz_embeddings(spark, f"file://{tmp_path}/e.npz", block=7).collect()}
    want = {str(n): [float(x) for x in v] for n, v in zip(names, vectors, strict=True)}
    assert got == want


def test_edges_of_archives(spark, tmp_path):
    np.savez(tmp_path / "none.npz", names=np.array([], dtype="<U3"), embeddings=np.zeros((0, 4)))
    assert npz_embeddings(spark, str(tmp_path / "none.npz")).count() == 0
    np.savez(tmp_path / "odd.npz", names=np.array(["a"]), embeddings=np.zeros((2, 4)))
    with pytest.raises(ValueError, match="1 names and 2"):
        npz_embeddings(spark, str(tmp_path / "odd.npz"))
    np.savez(tmp_path / "turned.npz", names=np.array(["a", "b"]), embeddings=np.asfortranarray(np.ones((2, 4))))
    with pytest.raises(ValueError, match="by rows"):
        npz_embeddings(spark, str(tmp_path / "turned.npz"))
