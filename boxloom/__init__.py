"""boxloom: Spark-first preparation of object-detection datasets.

Annotation exports are read as nested DataFrames, box percentages become
normalised label lines, image references are resolved and joined, video time
ranges become frame plans, and datasets are split reproducibly.  Everything is
a lazy DataFrame until a sink runs.
"""

__version__ = "0.1.0"
