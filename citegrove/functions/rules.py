"""The ordered rules by which a checkpoint's name gets its family, and generic classes that name none."""

FAMILIES = [
    (r"llama[\s\-_]*guard", "Llama Guard"), (r"code[\s\-_]*llama", "Code Llama"), (r"tiny[\s\-_]*llama", "TinyLlama"), (r"\bl+ama\b|\bllama", "Llama"),
    (r"mixtral", "Mixtral"), (r"mistral", "Mistral"), (r"\bgpt[\s\-_]*neox", "GPT-NeoX"), (r"\bgpt[\s\-_]*neo\b", "GPT-Neo"),
    (r"\bgpt[\s\-_]*j\b", "GPT-J"), (r"\bgpt\b|\bchatgpt\b", "GPT"), (r"claude", "Claude"), (r"gemini", "Gemini"), (r"\bgemma", "Gemma"), (r"\bpalm\b", "PaLM"),
    (r"qwen", "Qwen"), (r"vicuna", "Vicuna"), (r"deepseek", "DeepSeek"), (r"\bopt[\s\-_]*\d", "OPT"), (r"pythia", "Pythia"), (r"falcon", "Falcon"),
    (r"chatglm", "ChatGLM"), (r"mini[\s\-_]*gpt", "MiniGPT"), (r"llava", "LLaVA"), (r"instructblip", "InstructBLIP"), (r"cogvlm", "CogVLM"),
    (r"guanaco", "Guanaco"), (r"\bmpt[\s\-_]*\d", "MPT"), (r"\bphi[\s\-_]*\d", "Phi"), (r"zephyr", "Zephyr"), (r"\bbloom", "BLOOM"),
    (r"distil[\s\-_]*bert", "DistilBERT"), (r"roberta", "RoBERTa"), (r"\bbert\b", "BERT"), (r"\bt5\b|flan[\s\-_]*t5", "T5"),
]

GENERIC_CLASSES = [
    "transformer", "transformers", "mlp", "rnn", "lstm", "gru", "cnn", "gan", "vae", "resnet", "alexnet", "llm", "llms", "large language model",
    "large language models", "large language models (llms)", "language model", "language models", "neural network", "neural networks",
    "deep neural network", "pretrained language model", "pretrained language models", "pre-trained word embeddings", "word embeddings", "encoder", "decoder",
    "autoregressive language model", "vision language model", "vision-language models", "vlm", "vlms", "diffusion model", "diffusion models",
    "foundation model", "foundation models", "chat model", "chat models", "instruction-tuned model", "instruction-tuned models", "base model",
    "sparse autoencoder", "sparse autoencoders", "sparse autoencoders (saes)",
]
