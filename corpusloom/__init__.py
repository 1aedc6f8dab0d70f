"""corpusloom: a PySpark-native engine for news corpora, bylines and co-authorship networks."""
