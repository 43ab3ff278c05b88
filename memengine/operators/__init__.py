"""DataFrame operators: frames and parameters in, frame out."""
