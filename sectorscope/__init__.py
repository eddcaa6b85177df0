"""sectorscope: classify code repositories into industry sectors and report on them with Spark.

Layers
------
``functions``  Column -> Column expressions (text cleaning, codes, score arrays)
``operators``  DataFrame -> DataFrame building blocks
``sources``    readers and writers
``plans``      complete jobs composed from the operators
"""
