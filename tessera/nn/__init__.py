"""Small neural networks: scoring as expressions or Arrow batches, training as distributed gradients."""
