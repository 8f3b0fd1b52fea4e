"""pulsegrid: Spark-first analytics for event-camera streams (and, in ``pulsegrid.llm``, training-data operators)."""
