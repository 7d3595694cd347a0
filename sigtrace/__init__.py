"""Evidence tables of digitised drawings, fused and checked with Spark."""
