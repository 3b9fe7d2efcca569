"""topicloom: topic-model analytics as Spark DataFrame operators."""
