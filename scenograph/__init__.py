"""Spark-native engine for narrative knowledge bases: scenes, entities, links, retrieval and corpus preparation."""
