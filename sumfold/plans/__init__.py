"""Driver-side planning and the evaluation strategies that carry plans out."""
