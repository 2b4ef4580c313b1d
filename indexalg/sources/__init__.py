"""Texts to tokens, trees and tables."""
