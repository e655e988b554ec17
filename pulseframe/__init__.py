"""PulseFrame: a PySpark-native analytics engine for electrocardiogram sheets and text corpora."""
