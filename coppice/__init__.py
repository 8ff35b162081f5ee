"""Exact sparse decision trees and their near-optimal sets on Spark."""
