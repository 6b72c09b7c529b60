"""Execution helpers shared by the operators: staging tables and fixpoint loops."""
