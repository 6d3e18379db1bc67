"""vectables: tables of embeddings and the logs around them, as Spark DataFrame operators."""

SEED = 42          # default seed of every generator
TOP_K = 100        # search limit
BATCH_SIZE = 100   # points per write batch
