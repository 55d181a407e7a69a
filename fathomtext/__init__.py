"""Spark-native analytics over keyed text corpora, entity graphs and periodic statements."""
