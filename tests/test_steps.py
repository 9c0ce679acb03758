"""Steps of one file, the writer's lock and model names, each against what it must answer."""

import io
import os
import time

from pyspark.sql import functions as F

from postlake.catalog_files import _message, _plain_root, _remove, write_files
from postlake.operators import search
from postlake.runtime import Scratch
from postlake.sources.store import Store
from postlake.streaming.ingest import Ingest, StallWatch

FILE_STEPS = {
    "a_not_found": "not_found",
    "b_indexed": "indexed",
    "c_skipped": "skipped",
    "d_changed": "indexed",
    "e_moved": "moved",
    "f_failed": "failed",
    "g_reextracted": "ok 1 3",
    "h_missing": "missing_file",
    "i_unknown": "not_indexed",
    "j_prune_missing": "refused",
    "k_prune_empty": "refused",
    "l_nothing_to_do": "0 True",
}
LOCK_STEPS = {
    "a_free": "none",
    "b_taken": "index",
    "c_again": "none",
    "d_nested": "index",
    "e_foreign": "prune",
    "f_not_mine": "False",
    "g_dead": "none",
    "h_garbage": "none",
    "i_released": "True",
    "j_state": "2024-05-01T00:00:00+00:00",
    "k_bad_state": "none",
    "l_stalled": "writing batch 2",
}
MODELS = {
    "BGE-base-en-v1.5": "BAAI/bge-base-en-v1.5",
    "BGE-small-en-v1.5": "BAAI/bge-small-en-v1.5",
    "nomic-embed-text-v1": "nomic-ai/nomic-embed-text-v1",
    "all-MiniLM-L6-v2": "sentence-transformers/all-MiniLM-L6-v2",
    "my/model": "my/model",
    "local": "local",
    "remote": "remote again",
}


def single_file_steps(spark):
    """One file at a time: its status, reextraction of one message, what prune refuses, a run that finds nothing."""
    scratch = Scratch(spark, "single")
    root = _plain_root(scratch)
    k = F.lit(1)
    put = lambda name, subject, at: write_files(spark.range(1).select(F.lit(name).alias("name"), _message(k, F.lit(subject)).alias("content")), root, at)
    ingest = Ingest(Store(spark, scratch.path("index"), buckets=4))
    steps = {"a_not_found": ingest.index_file(f"{root}/1.eml")["status"]}
    put("/1.eml", "one", 1e9)
    steps["b_indexed"], steps["c_skipped"] = ingest.index_file(f"{root}/1.eml")["status"], ingest.index_file(f"{root}/1.eml")["status"]
    put("/1.eml", "two", 1.1e9)
    steps["d_changed"] = ingest.index_file(f"{root}/1.eml")["status"]
    _remove(spark.range(1).select(F.lit("/1.eml").alias("name")), root)
    put("/2.eml", "two", 1.1e9)
    steps["e_moved"] = ingest.index_file(f"{root}/2.eml")["status"]
    put("/x.txt", "no", 1e9)
    steps["f_failed"] = ingest.index_file(f"{root}/x.txt")["status"]
    ingest.store.commit(emails=ingest.store.table("emails").withColumn("extraction_version", F.lit(1)))
    out = ingest.reextract_one(message_id="s1@ex.org")
    steps["g_reextracted"] = " ".join([out["status"], *map(str, out.get("version", []))])
    _remove(spark.range(1).select(F.lit("/2.eml").alias("name")), root)
    steps["h_missing"] = ingest.reextract_one(file_path=f"{root}/2.eml")["status"]
    steps["i_unknown"] = ingest.reextract_one(file_path="/nowhere")["status"]
    for step, folder in (("j_prune_missing", root + "/none"), ("k_prune_empty", root)):
        try:
            ingest.prune(folder)
            steps[step] = "done"
        except ValueError:
            steps[step] = "refused"
    run = ingest.index(root)
    steps["l_nothing_to_do"] = f"{run.candidates} {run.watermark is not None}"
    return steps


def lock_steps(spark):
    """The writer's lock, its state file, and what a stalled run says."""
    scratch = Scratch(spark, "lock")
    store = Store(spark, scratch.path("index"))
    kind = lambda h: "none" if h is None else h["kind"]
    steps = {"a_free": kind(store.lock_holder())}
    store.acquire("index")
    steps["b_taken"], steps["c_again"] = kind(store.lock_holder()), kind(store.acquire("index"))
    with store.locked("inner"):
        pass
    steps["d_nested"] = kind(store.lock_holder())
    store.release()
    store.acquire("prune", pid=os.getppid())
    steps["e_foreign"], steps["f_not_mine"] = kind(store.acquire("index")), str(store.release())
    store.release(pid=os.getppid())
    store.acquire("old", pid=2**22 + 5)  # above the largest process id
    steps["g_dead"] = kind(store.acquire("index"))
    store.release()
    store.files.create("writer.lock", "{broken", overwrite=True)
    steps["h_garbage"] = kind(store.lock_holder())
    store.acquire("index")
    steps["i_released"] = str(store.release())
    store.set_state("scan_watermark", "2024-05-01T00:00:00+00:00")
    steps["j_state"] = store.watermark().isoformat()
    store.files.create("state.json", "broken", overwrite=True)
    steps["k_bad_state"] = str(store.watermark()).lower()
    said = io.StringIO()
    with StallWatch(spark, 0.1, said) as watch:
        watch.mark("writing batch 2")
        for _ in range(100):
            time.sleep(0.05)
            if watch.dumps:
                break
    steps["l_stalled"] = said.getvalue().partition("\n")[0].partition("while ")[2]
    return steps


def model_names():
    """Short names of models, and loading from the local cache before anywhere else."""

    def load(name: str, local_files_only: bool = False) -> str:
        if name == "remote" and local_files_only:
            raise OSError("not in the cache")
        return name if local_files_only else f"{name} again"

    names = ["BGE-base-en-v1.5", "BGE-small-en-v1.5", "nomic-embed-text-v1", "all-MiniLM-L6-v2", "my/model"]
    rows = [(n, search.resolve_model(n)) for n in names] + [(n, search.load_local_first(n, load)) for n in ("local", "remote")]
    return dict(rows)


def test_one_file_at_a_time(spark):
    assert single_file_steps(spark) == FILE_STEPS


def test_lock_state_and_stalls(spark):
    assert lock_steps(spark) == LOCK_STEPS


def test_names_of_models():
    assert model_names() == MODELS
